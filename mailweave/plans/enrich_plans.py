"""Extension queries: transform chains, enrichment, redaction, reports,
custom-data predicates and pandas UDF adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import CARD_PATTERN, CARD_REPLACEMENT
from ..operators import attachments as AT
from ..operators import enrich as EN
from ..sources import fixtures as fx
from ..sources.tables import table
from .attachment_plans import ATT
from .registry import register
from .sqlfrag import M, with_m

URG = "(?i)(urgent|asap|emergency)"
PHONE = r"\b\d{3}-\d{3}-\d{4}\b"


def _enriched(spark, sf):
    return EN.urgency_and_phones(fx.messages(spark, sf))


ENRICH_SQL = with_m(f"""SELECT message_id,
  CASE WHEN NOT is_read THEN CASE WHEN regexp_matches(subject, '{URG}') THEN 'urgent' ELSE 'normal' END END AS priority,
  CASE WHEN NOT is_read AND len(regexp_extract_all(coalesce(body, ''), '{PHONE}')) > 0
       THEN array_to_string(regexp_extract_all(coalesce(body, ''), '{PHONE}'), ',') END AS phone_numbers
FROM m""")


@register("enrich_messages", ENRICH_SQL)
def q_enrich_messages(spark, sf):
    e = _enriched(spark, sf)
    return e.select("message_id", F.try_element_at("custom_data", F.lit("priority")).alias("priority"),
                    F.try_element_at("custom_data", F.lit("phone_numbers")).alias("phone_numbers"))


@register("redact_cards", f"""SELECT doc_id, regexp_replace(text, '{CARD_PATTERN}', '{CARD_REPLACEMENT}', 'g')
  AS text FROM documents""")
def q_redact_cards(spark, sf):
    from ..functions.text import redact_cards
    return table(spark, sf, "documents").select("doc_id", redact_cards(F.col("text")).alias("text"))


@register("transform_chain", with_m(f"""SELECT message_id, lower(subject) AS subject,
  regexp_replace(body, '{CARD_PATTERN}', '{CARD_REPLACEMENT}', 'g') AS body FROM m"""))
def q_transform_chain(spark, sf):
    reg = EN.Registry()
    chain = reg.get_filter("message_content")
    assert chain is reg.get_filter("message_content")
    chain.add(EN.redact_body, priority=5)
    chain.add(lambda df: df.withColumn("subject", F.lower("subject")), priority=10)
    chain.add(lambda df: df.withColumn("body", F.col("no_such_column")), priority=7)   # skipped
    out = reg.apply_filter("message_content", fx.messages(spark, sf))
    return out.select("message_id", "subject", "body")


def _label_sizes(df):
    return (df.filter(~F.col("is_deleted")).select(F.explode("labels").alias("label"), "size")
              .groupBy("label").agg(F.sum("size").cast("bigint").alias("total_size"),
                                    F.count(F.lit(1)).alias("messages")))


@register("custom_report", with_m("""SELECT label, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS messages
FROM (SELECT unnest(list_filter([label_1, label_2, label_3], lambda x: x IS NOT NULL)) AS label, size FROM live)
GROUP BY label"""))
def q_custom_report(spark, sf):
    reg = EN.Registry()
    reg.register_report("label_sizes", _label_sizes)
    return reg.report("label_sizes", fx.messages(spark, sf))


@register("custom_data_filter", f"""WITH {M}, {ATT},
e AS (SELECT message_id, CASE WHEN NOT is_read THEN CASE WHEN regexp_matches(subject, '{URG}')
        THEN 'urgent' ELSE 'normal' END END AS priority FROM m),
c AS (SELECT message_id, count(*) AS attachment_count FROM att GROUP BY 1)
SELECT e.message_id, CAST(c.attachment_count AS BIGINT) AS attachment_count, e.priority
FROM e JOIN c ON e.message_id = c.message_id WHERE e.priority IS NOT NULL AND c.attachment_count > 0""")
def q_custom_data_filter(spark, sf):
    e = AT.attachment_counts(_enriched(spark, sf), fx.attachments_landed(spark, sf))
    pr = F.try_element_at("custom_data", F.lit("priority"))
    return (e.filter((F.col("attachment_count") > 0) & pr.isNotNull())
             .select("message_id", "attachment_count", pr.alias("priority")))


def _plain_letters(s):
    """Letters without their accents: nothing built in does it."""
    import unicodedata
    return s.map(lambda x: None if x is None else "".join(
        c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


@register("udf_adapter", with_m("""SELECT message_id, strip_accents(subject) AS plain_subject, subject IS NOT NULL AS has_subject FROM m"""))
def q_udf_adapter(spark, sf):
    plain = EN.scalar_udf(_plain_letters, "string")
    m = fx.messages(spark, sf).select("message_id", plain(F.col("subject")).alias("plain_subject"))

    def flags(pdf):
        return pdf.assign(has_subject=pdf["plain_subject"].notna())
    return EN.batch_transform(m, flags, "message_id string, plain_subject string, has_subject boolean")
