"""Raw JSON parsing queries (B1-B18) over the landed ``raw`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses as AD, dates as DT, mime as MI, text as TX
from ..operators import parse as P
from ..sources import fixtures as fx
from ..sources.tables import table
from .registry import register
from .sqlfrag import LABEL_ID, html_text, with_m


def _parsed(spark, sf):
    good, _ = P.parse_messages(fx.raw_messages(spark, sf), fx.label_map(spark), fx.AS_OF)
    return good


def _emails(key):
    return F.array_join(F.transform(F.try_element_at("recipients", F.lit(key)), lambda r: r["email"]), ",")


PARSED_COLS = f"""message_id, thread_id,
  CASE WHEN sender_email IS NULL THEN NULL ELSE sender_name END AS sender_name, sender_email,
  to_email AS to_emails, cc_email AS cc_emails,
  CASE WHEN event_id % 29 = 0 THEN '' ELSE array_to_string(list_filter(
    [label_1, label_2, label_3, CASE WHEN is_outgoing THEN 'SENT' END], lambda x: x IS NOT NULL), ',') END AS labels,
  subject, {html_text('body')} AS body,
  CASE WHEN event_id % 23 = 0 THEN 0 ELSE size END AS size,
  CASE WHEN event_id % 13 = 5 THEN date_trunc('second', timestamp) ELSE date_trunc('millisecond', timestamp) END
    AS timestamp,
  CASE WHEN event_id % 29 = 0 THEN false ELSE is_read END AS is_read,
  CASE WHEN event_id % 29 = 0 THEN false ELSE is_outgoing END AS is_outgoing"""
PARSED_SQL = with_m(f"SELECT {PARSED_COLS} FROM m WHERE event_id % 100 <> 37")


@register("parse_raw", PARSED_SQL)
def q_parse_raw(spark, sf):
    return flat_parsed(_parsed(spark, sf))


def flat_parsed(g):
    return g.select("message_id", "thread_id", F.col("sender.name").alias("sender_name"),
                    F.col("sender.email").alias("sender_email"), _emails("to").alias("to_emails"),
                    _emails("cc").alias("cc_emails"), F.array_join("labels", ",").alias("labels"),
                    "subject", "body", "size", "timestamp", "is_read", "is_outgoing")


# The landed text as to_json writes it, far enough for the 80 characters that broken rows keep.
QUARANTINE_SQL = with_m(f"""SELECT substr(concat('{{"id":"', message_id, '","threadId":"', thread_id, '"',
  CASE WHEN event_id % 23 <> 0 THEN concat(',"sizeEstimate":', size) ELSE '' END,
  CASE WHEN event_id % 13 <> 5 THEN concat(',"internalDate":"', epoch_us(timestamp) // 1000, '"') ELSE '' END,
  CASE WHEN event_id % 29 <> 0 THEN concat(',"labelIds":["', concat_ws('","', {LABEL_ID}, label_2, label_3,
    CASE WHEN is_outgoing THEN 'SENT' END, CASE WHEN event_id % 9 = 0 THEN 'L9' END), '"]') ELSE '' END,
  ',"payload":{{"mimeType":"', CASE WHEN event_id % 17 = 3 THEN 'text/plain' ELSE 'multipart/mixed' END,
  '","headers":[{{"name":"'), 1, 80) AS value, 'unparseable_json' AS reason
FROM m WHERE event_id % 100 = 37""")


@register("parse_quarantine", QUARANTINE_SQL)
def q_parse_quarantine(spark, sf):
    _, bad = P.parse_messages(fx.raw_messages(spark, sf), fx.label_map(spark), fx.AS_OF)
    return bad


@register("label_names", with_m(f"""SELECT message_id,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat_ws(',', {LABEL_ID}, label_2, label_3,
    CASE WHEN is_outgoing THEN 'SENT' END, CASE WHEN event_id % 9 = 0 THEN 'L9' END) END AS label_ids,
  CASE WHEN event_id % 29 = 0 THEN '' ELSE concat_ws(',', label_1, label_2, label_3,
    CASE WHEN is_outgoing THEN 'SENT' END) END AS labels
FROM m WHERE event_id % 100 <> 37"""))
def q_label_names(spark, sf):
    raw = fx.raw_messages(spark, sf)
    v = F.col("_v")
    d = raw.select(F.try_parse_json("value").alias("_v"), F.spark_partition_id().alias("_barrier"))   # parsed once, see P.parse_variant
    d = d.select(F.try_variant_get(v, "$.id", "string").alias("message_id"), F.try_variant_get(v, "$.labelIds", "array<string>").alias("ids"),
                 fx.label_map(spark).alias("_dict"), "_barrier").filter(F.col("message_id").isNotNull() & (F.col("_barrier") >= 0))
    lm = F.col("_dict")
    names = F.transform(F.filter("ids", lambda x: F.map_contains_key(lm, x)), lambda x: F.element_at(lm, x))
    return d.select("message_id", F.array_join("ids", ",").alias("label_ids"),
                    F.array_join(F.coalesce(names, F.array().cast("array<string>")), ",").alias("labels"))


@register("parse_date_header", with_m("""SELECT message_id,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', timestamp) END AS parsed_ts FROM m"""))
def q_parse_date_header(spark, sf):
    f = fx.flat_messages(spark, sf)
    eid, ts = F.col("event_id"), F.col("timestamp")
    hdr = (F.when(eid % 4 == 0, DT.rfc2822(ts, 0))
            .when(eid % 4 == 1, F.concat(DT.rfc2822(ts, 330), F.lit(" (IST)")))
            .when(eid % 4 == 2, F.substring(DT.rfc2822(ts, -300), 6, 100))
            .otherwise(F.concat(F.lit("not a date "), eid)))
    return f.select("message_id", DT.parse_rfc2822(hdr).alias("parsed_ts"))


@register("parse_addresses", with_m("""SELECT message_id,
  sender_name AS from_name, coalesce(sender_email, '') AS from_email,
  concat_ws(',', CASE WHEN coalesce(sender_email, '') <> '' THEN lower(sender_email) END,
            to_email, concat('f', event_id, '@x.org'), 'bad') AS emails,
  concat_ws('|', CASE WHEN coalesce(sender_email, '') <> '' THEN sender_name END, '', 'Friend', '') AS names
FROM m"""))
def q_parse_addresses(spark, sf):
    f = fx.flat_messages(spark, sf)
    first = F.concat(F.lit('"'), F.col("sender_name"), F.lit('" <'), F.coalesce("sender_email", F.lit("")),
                     F.lit(">"))
    hdr = F.concat(first, F.lit(", "), F.upper("to_email"), F.lit(", Friend <F"), F.col("event_id"),
                   F.lit("@X.org>, ,bad"))
    lst = AD.parse_address_list(hdr)
    one = AD.parse_address(first)
    return f.select("message_id", one["name"].alias("from_name"), one["email"].alias("from_email"),
                    F.array_join(F.transform(lst, lambda a: a["email"]), ",").alias("emails"),
                    F.array_join(F.transform(lst, lambda a: a["name"]), "|").alias("names"))


@register("decode_body", """SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE text END AS decoded
FROM documents""")
def q_decode_body(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    enc = MI.b64url_encode(F.col("text"))
    enc = F.when(F.col("doc_id") % 3 == 0, F.rtrim(enc, F.lit("="))).otherwise(enc)
    enc = F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("!!"), enc)).otherwise(enc)
    return d.select("doc_id", MI.b64url_decode(enc).alias("decoded"))


@register("body_select", with_m(f"""SELECT message_id,
  CASE WHEN body IS NULL THEN NULL WHEN event_id % 17 = 3 THEN 'payload' ELSE '0000.0000' END AS body_path,
  {html_text('body')} AS body FROM m WHERE event_id % 100 <> 37"""))
def q_body_select(spark, sf):
    p = P.parse_variant(fx.raw_messages(spark, sf), fx.label_map(spark))
    return p.filter(F.col("_reason").isNull()).select("message_id", "body_path", "body")


@register("part_walk", with_m("""SELECT message_id, path, depth, mime_type FROM (
  SELECT event_id, message_id, '0000' AS path, 1 AS depth, 'multipart/alternative' AS mime_type FROM m
  UNION ALL SELECT event_id, message_id, '0000.0000', 2, 'text/plain' FROM m
  UNION ALL SELECT event_id, message_id, '0000.0001', 2, 'text/html' FROM m
  UNION ALL SELECT event_id, message_id, '0001', 1, 'application/pdf' FROM m WHERE event_id % 6 = 0) x
WHERE event_id % 100 <> 37 AND event_id % 17 <> 3"""))
def q_part_walk(spark, sf):
    return P.parts_table(fx.raw_messages(spark, sf)).select("message_id", "path", "depth", "mime_type")


@register("html_to_text", f"SELECT page_id, {html_text('html')} AS text FROM pages")
def q_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", TX.html_to_text(F.col("html")).alias("text"))


@register("attachment_parts", with_m("""SELECT message_id, '0001' AS path, 'application/pdf' AS mime_type,
  concat('att-', event_id) AS attachment_id, size % 100000 AS size, concat('report ', event_id, '.pdf') AS filename,
  false AS is_inline, concat('<att', event_id, '>') AS content_id
FROM m WHERE event_id % 6 = 0 AND event_id % 100 <> 37 AND event_id % 17 <> 3"""))
def q_attachment_parts(spark, sf):
    return P.attachment_parts(fx.raw_messages(spark, sf))
