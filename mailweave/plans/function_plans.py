"""Scalar functions (J1, J2, J5, J6) and stored versions and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as SC
from ..functions.dates import from_epoch_millis
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.files import attachment_files
from ..sources.tables import table
from .registry import register
from .sqlfrag import LABELS, with_m

SENDER_JSON = """concat('{', concat_ws(',', concat('"name":"', sender_name, '"'),
  CASE WHEN sender_email IS NOT NULL THEN concat('"email":"', sender_email, '"') END), '}')"""


@register("json_extract", with_m(f"SELECT message_id, sender_email AS email, sender_name AS name, {SENDER_JSON} AS whole FROM m"))
def q_json_extract(spark, sf):
    m = fx.messages(spark, sf, text=False).select("message_id", F.to_json("sender").alias("j"))
    return m.select("message_id", F.get_json_object("j", "$.email").alias("email"),
                    F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$").alias("whole"))


@register("json_roundtrip", with_m(f"""SELECT message_id, to_email, cc_email, array_to_string({LABELS}, ',') AS labels,
  concat('["', array_to_string({LABELS}, '","'), '"]') AS labels_json FROM m"""))
def q_json_roundtrip(spark, sf):
    m = fx.messages(spark, sf, text=False)
    j = m.select("message_id", F.to_json("recipients").alias("r"), F.to_json("labels").alias("labels_json"))
    kind = SC.MESSAGES["recipients"].dataType
    j = j.select("message_id", "labels_json", F.from_json("r", kind).alias("r"),
                 F.from_json("labels_json", SC.MESSAGES["labels"].dataType).alias("l"))
    email = lambda k: F.try_element_at("r", F.lit(k))[0]["email"]
    return j.select("message_id", email("to").alias("to_email"), email("cc").alias("cc_email"),
                    F.array_join("l", ",").alias("labels"), "labels_json")


@register("date_functions", with_m("""SELECT message_id, epoch_us(timestamp) // 1000 AS epoch_ms, epoch_us(timestamp) // 1000000 AS epoch_s,
  date_trunc('second', timestamp) AS from_iso, date_trunc('millisecond', timestamp) AS from_ms,
  date_trunc('day', timestamp) AS day_start, date_trunc('day', timestamp) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end,
  strftime(timestamp, '%a %b %d %H:%M:%S %Y') AS asctime FROM m"""))
def q_date_functions(spark, sf):
    m = fx.messages(spark, sf, text=False).select("message_id", "timestamp")
    t = F.col("timestamp")
    ms = F.unix_millis(t.cast("timestamp"))
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    day = F.date_trunc("day", t).cast("timestamp_ntz")
    return m.select("message_id", ms.alias("epoch_ms"), F.unix_timestamp(t.cast("timestamp")).alias("epoch_s"),
                    F.to_timestamp_ntz(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("from_iso"),
                    from_epoch_millis(ms.cast("string")).alias("from_ms"), day.alias("day_start"),
                    (day + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.000001 SECOND")).alias("day_end"),
                    F.date_format(t, "EEE MMM dd HH:mm:ss yyyy").alias("asctime"))


@register("string_functions", with_m(f"""SELECT message_id, lower(subject) AS lowered, contains(lower(subject), 'the') AS has_the,
  starts_with(subject, 'T') AS starts_t, lower(subject) LIKE '%nd%' AS like_nd, substr(subject, 1, 20) AS cut,
  concat(substr(label_1, 1, 1), lower(substr(label_1, 2))) AS titled, array_to_string({LABELS}, '|') AS joined,
  CAST(len(string_split(subject, ' ')) AS INTEGER) AS n_words, trim('  ' || subject || ' ') AS stripped FROM m"""))
def q_string_functions(spark, sf):
    s = F.col("subject")
    return fx.messages(spark, sf).select(
        "message_id", F.lower(s).alias("lowered"), F.contains(F.lower(s), F.lit("the")).alias("has_the"),
        F.startswith(s, F.lit("T")).alias("starts_t"), s.ilike("%nd%").alias("like_nd"), F.substring(s, 1, 20).alias("cut"),
        F.initcap(F.element_at("labels", 1)).alias("titled"), F.array_join("labels", "|").alias("joined"),
        F.size(F.split(s, " ", -1)).alias("n_words"), F.trim(F.concat(F.lit("  "), s, F.lit(" "))).alias("stripped"))


@register("schema_version", with_m("SELECT message_id, is_deleted, 0 AS before, 1 AS after FROM (SELECT message_id, false AS is_deleted FROM m)"))
def q_schema_version(spark, sf):
    """A version-0 table is brought to the current version, which is recorded beside it."""
    at = scratch_path(spark, "versioned")
    before = SC.read_version(spark, at)
    df = SC.evolve_schema(fx.messages(spark, sf, text=False).drop("is_deleted"), before)
    SC.write_version(spark, at, SC.CURRENT_SCHEMA_VERSION)
    after = SC.read_version(spark, at)
    return SC.evolve_schema(df, after).select("message_id", "is_deleted", F.lit(before).alias("before"), F.lit(after).alias("after"))


@register("attachment_files", """SELECT CAST(doc_id % 16 AS INTEGER) AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS total_size,
  CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1""")
def q_attachment_files(spark, sf):
    """Texts landed as plain files, then listed and read as files."""
    at = scratch_path(spark, "files")
    d = table(spark, sf, "documents").select((F.col("doc_id") % 16).cast("int").alias("folder"), F.coalesce("text", F.lit("")).alias("text"))
    d.repartition("folder").write.partitionBy("folder").text(at)
    files = attachment_files(spark, at, "*.txt")
    lines = F.length("content") - F.octet_length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return (files.select(F.regexp_extract("path", r"folder=(\d+)/", 1).cast("int").alias("folder"), "length", lines.alias("n"))
            .groupBy("folder").agg(F.sum("length").alias("total_size"), F.sum("n").cast("bigint").alias("lines")))
