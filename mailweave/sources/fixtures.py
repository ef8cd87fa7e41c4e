"""Derived fixtures: the ``messages`` table and its companions, built by
Spark from the driver tables (rules in FIXTURES.md). Every frame here is
lazy; nothing is collected, so the work grows with the input tables.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import conform
from ..session import dealt
from .tables import table

# The evaluation clock for "now"-relative queries (events
# fall in January 2024) and the one used for the order timeline.
AS_OF = _dt.datetime(2024, 2, 1, 0, 0, 0)
AS_OF_ORDERS = _dt.datetime(2001, 9, 1, 0, 0, 0)

# User label ids of the label dictionary, in this order,
# for event types click, error, purchase, signup, view; L9 is left out
# of the dictionary on purpose (an unknown id).
USER_LABEL_IDS = {"click": "L0", "error": "L1", "purchase": "L2", "signup": "L3", "view": "L4"}
SYSTEM_LABELS = ["IMPORTANT", "CATEGORY_UPDATES", "UNREAD", "SENT", "INBOX"]
UNKNOWN_LABEL_ID = "L9"


def _ts(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def flat_messages(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """FIXTURES 3.1 flat ``m`` plus ``event_id`` (kept for derivations). Without
    ``text`` subject and body are null and ``documents`` is not read. Subjects are cut before
    the join: a query without bodies moves no whole text."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    if text:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 60).alias("_subject"))
        n_docs = docs.select(F.count(F.lit(1))).scalar()
        e = dealt(e, "event_id").withColumn("_doc_key", F.col("event_id") % n_docs)
        j = e.join(docs, e["_doc_key"] == docs["doc_id"], "left")
    else:
        j = e.withColumns({c: F.lit(None).cast("string") for c in ("text", "_subject")})
    eid, uid = F.col("event_id"), F.col("user_id")
    return j.select(
        eid,
        F.concat(F.lit("m"), eid).alias("message_id"),
        F.when(eid % 10 == 0, F.concat(F.lit("s"), eid))
         .when(eid % 10 < 4, F.concat(F.lit("t"), F.floor(eid / 10).cast("bigint")))
         .otherwise(F.concat(F.lit("l"), F.floor(eid / 40).cast("bigint"))).alias("thread_id"),
        F.when(eid % 97 == 0, F.lit(""))
         .when(eid % 89 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("User"), uid, F.lit("@mail"), uid % 5, F.lit(".example.com")))
         .alias("sender_email"),
        F.concat(F.lit("User "), uid, F.lit(" v"), eid % 3).alias("sender_name"),
        F.concat(F.lit("user"), (uid + 1) % 50, F.lit("@mail0.example.com")).alias("to_email"),
        F.when(eid % 3 == 0, F.concat(F.lit("user"), (uid + 7) % 50, F.lit("@mail1.example.com")))
         .alias("cc_email"),
        F.upper("event_type").alias("label_1"),
        F.when(F.col("value") > 250, F.lit("IMPORTANT")).otherwise(F.lit("CATEGORY_UPDATES")).alias("label_2"),
        F.when(F.col("event_type") == "error", F.lit("UNREAD")).alias("label_3"),
        F.when(eid % 61 == 0, F.lit(None).cast("string")).otherwise(F.col("_subject")).alias("subject"),
        F.when(eid % 67 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("body"),
        F.floor(F.col("value") * F.col("value") * 8).cast("bigint").alias("size"),
        _ts(F.col("ts")).alias("timestamp"),
        (F.col("event_type") != "error").alias("is_read"),
        F.col("event_type").isin("purchase", "signup").alias("is_outgoing"),
        (eid % 50 == 7).alias("is_deleted"),
        F.col("event_type"),
    )


def nest(flat: DataFrame) -> DataFrame:
    """Flat fixture columns → typed ``messages`` columns (keeps extras)."""
    addr = lambda c: F.array(F.struct(F.col(c).alias("email"), F.lit("").alias("name")))
    entries = F.array(
        F.struct(F.lit("to").alias("key"), addr("to_email").alias("value")),
        F.struct(F.lit("cc").alias("key"),
                 F.when(F.col("cc_email").isNotNull(), addr("cc_email")).alias("value")),
    )
    return flat.select(
        "*",
        F.struct(F.col("sender_name").alias("name"), F.col("sender_email").alias("email")).alias("sender"),
        F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("recipients"),
        F.filter(F.array("label_1", "label_2", "label_3"), lambda x: x.isNotNull()).alias("labels"),
        F.col("timestamp").alias("last_indexed"),
        F.lit(None).cast("map<string,string>").alias("custom_data"),
    )


def messages(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """The typed ``messages`` table derived from ``events`` + ``documents``
    (without ``text``: from ``events`` alone, subject and body null)."""
    return conform(nest(flat_messages(spark, sf_dir, text)))


def messages_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` plus the numeric ``event_id`` used by fixture rules."""
    return _conform_keep(nest(flat_messages(spark, sf_dir)), "event_id")


def _conform_keep(df: DataFrame, *extra: str) -> DataFrame:
    c = conform(df)
    return df.select(*extra, *[F.col(x).cast(c.schema[x].dataType).alias(x) for x in c.columns])


def order_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message-shaped timeline over ``orders.o_orderdate`` (1995-2001) for
    month / year / 24-month-window checks; nothing is deleted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return o.select(
        F.concat(F.lit("o"), "o_orderkey").alias("message_id"),
        _ts(F.col("o_orderdate")).alias("timestamp"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("size"),
        F.lit(False).alias("is_deleted"),
    )


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = messages_keyed(spark, sf_dir)
    return k.filter(F.col("event_id") % 5 != 0).drop("event_id")


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-fetched copies: read flag flipped, labels replaced, a changed
    subject (which an upsert must not apply) and a newer index time."""
    k = messages_keyed(spark, sf_dir).filter((F.col("event_id") % 5).isin(0, 1))
    return conform(k.withColumns({
        "is_read": ~F.col("is_read"),
        "labels": F.array(F.lit("INBOX"), F.concat(F.lit("REFILED_"), F.col("event_id") % 4)),
        "subject": F.concat(F.lit("RE: "), F.coalesce(F.col("subject"), F.lit(""))),
        "is_deleted": F.lit(False),
        "last_indexed": F.lit(AS_OF).cast("timestamp_ntz"),
    }))


def remote_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return e.filter(F.col("event_id") % 7 != 0).select(F.concat(F.lit("m"), "event_id").alias("message_id"))


def label_dict(spark: SparkSession) -> DataFrame:
    rows = [(i, t.upper()) for t, i in USER_LABEL_IDS.items()] + [(s, s) for s in SYSTEM_LABELS]
    return spark.createDataFrame(rows, "label_id string, label_name string")


def label_map(spark: SparkSession) -> Column:
    """The dictionary as one map value: a scalar subquery, evaluated once
    and shipped to every task (no join, no shuffle)."""
    d = label_dict(spark)
    return d.select(F.map_from_entries(F.collect_list(F.struct("label_id", "label_name")))).scalar()


# ---------------------------------------------------------------- attachments

# Attachment extensions by doc_id % 4.
ATT_EXTENSIONS = ["pdf", "txt", "docx", "exe"]


def attachments_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``att``: one file per document plus one ``.html`` file per page, in
    the shape of Spark's ``binaryFile`` source (path, modificationTime,
    length, content) plus ``message_id`` and ``filename``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ext = F.element_at(F.array(*[F.lit(x) for x in ATT_EXTENSIONS]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = d.select(
        F.concat(F.lit("m"), "doc_id").alias("message_id"),
        F.concat(F.lit("report "), "doc_id", F.lit("."), ext).alias("filename"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
        (F.lit(_dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
         - F.make_dt_interval(F.col("doc_id") % 400)).alias("modificationTime"),
    )
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    pages = p.select(
        F.concat(F.lit("p"), "page_id").alias("message_id"),
        F.concat(F.lit("page "), "page_id", F.lit(".html")).alias("filename"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"),
        (F.lit(_dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
         - F.make_dt_interval(F.col("page_id") % 400)).alias("modificationTime"),
    )
    out = docs.unionByName(pages)
    return out.select(
        F.concat(F.lit("att/"), "message_id", F.lit("/"), "filename").alias("path"),
        "modificationTime", F.length("content").cast("bigint").alias("length"), "content",
        "message_id", "filename",
    )


# ------------------------------------------------------------------ raw JSON
# Header-name spellings used to land raw messages (the
# parser must match names case-insensitively).
SUBJECT_SPELLINGS = ["Subject", "SUBJECT", "subject", "SuBjEcT"]


def _hdr(name, value) -> Column:
    return F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"),
                    value.alias("value"))


def raw_messages(spark: SparkSession, sf_dir: str, body_source: str = "documents",
                 keep_key: bool = False) -> DataFrame:
    """``raw``: one JSON text per message in the REST shape (FIXTURES 2).

    Rules (all by ``event_id``): ``% 100 = 37`` truncated (broken) JSON;
    ``% 13 = 5`` no ``internalDate`` (Date header used); ``% 23 = 0`` no
    ``sizeEstimate``; ``% 29 = 0`` no ``labelIds``; ``% 9 = 0`` an unknown
    label id; ``% 11 = 0`` an earlier stale duplicate Subject header;
    ``% 17 = 3`` body at top level instead of in parts; ``% 6 = 0`` an
    attachment part; Date header zone offset ``(event_id % 5 - 2) * 90`` min.
    With ``body_source='pages'`` the body is the HTML of a page (``raw_html``).
    """
    from ..functions.dates import rfc2822
    from ..functions.mime import b64url_encode

    f = flat_messages(spark, sf_dir)
    eid = F.col("event_id")
    if body_source == "pages":
        pages = table(spark, sf_dir, "pages").select("page_id", "html")
        n = pages.select(F.count(F.lit(1))).scalar()
        f = f.withColumn("_pk", eid % n)
        f = f.join(pages, f["_pk"] == pages["page_id"], "left").withColumn("body", F.col("html"))

    label_id = F.create_map(*[x for t, i in USER_LABEL_IDS.items() for x in (F.lit(t), F.lit(i))])
    ids = F.filter(F.array(
        label_id[F.col("event_type")], F.col("label_2"), F.col("label_3"),
        F.when(F.col("is_outgoing"), F.lit("SENT")),
        F.when(eid % 9 == 0, F.lit(UNKNOWN_LABEL_ID))), lambda x: x.isNotNull())

    subj_name = F.element_at(F.array(*[F.lit(s) for s in SUBJECT_SPELLINGS]), (eid % 4 + 1).cast("int"))
    from_value = F.when(eid % 2 == 0, F.concat(F.lit('"'), F.col("sender_name"), F.lit('" <'),
                                               F.col("sender_email"), F.lit(">"))) \
                  .otherwise(F.concat(F.col("sender_name"), F.lit(" <"), F.col("sender_email"), F.lit(">")))
    offset = ((eid % 5 - 2) * 90).cast("int")
    headers = F.filter(F.array(
        F.when((eid % 11 == 0) & F.col("subject").isNotNull(), _hdr("Subject", F.lit("stale"))),
        F.when(F.col("subject").isNotNull(), _hdr(subj_name, F.col("subject"))),
        F.when(F.col("sender_email").isNotNull(), _hdr("From", from_value)),
        _hdr("To", F.col("to_email")),
        F.when(F.col("cc_email").isNotNull(), _hdr("Cc", F.col("cc_email"))),
        _hdr("Date", rfc2822(F.col("timestamp"), offset)),
    ), lambda h: h.isNotNull())

    top_level = eid % 17 == 3
    f = f.withColumns({"_data": b64url_encode(F.col("body")),     # encoded once, however often it is written
                       "_html": F.when(~top_level, b64url_encode(F.concat(F.lit("<div>"), F.col("body"), F.lit("</div>"))))})
    data, size = F.col("_data"), F.length("body")
    # Parts are written as text, keys in order as a variant has them, and put into the message's text.
    leaf = lambda mt, d: F.struct(F.struct(d.alias("data"), size.alias("size")).alias("body"),
                                  F.lit(mt).alias("mimeType"))
    alt = F.struct(
        F.struct(F.lit(0).alias("size")).alias("body"),
        F.lit("multipart/alternative").alias("mimeType"),
        F.array(leaf("text/plain", data), leaf("text/html", F.col("_html"))).alias("parts"))
    attach = F.struct(
        F.struct(F.concat(F.lit("att-"), eid).alias("attachmentId"), (F.col("size") % 100000).alias("size"))
         .alias("body"),
        F.concat(F.lit("report "), eid, F.lit(".pdf")).alias("filename"),
        F.array(_hdr("Content-Disposition", F.concat(F.lit('attachment; filename="report '), eid, F.lit('.pdf"'))),
                _hdr("Content-ID", F.concat(F.lit("<att"), eid, F.lit(">")))).alias("headers"),
        F.lit("application/pdf").alias("mimeType"))
    parts = F.concat(F.lit(',"parts":['), F.concat_ws(",", F.to_json(alt), F.when(eid % 6 == 0, F.to_json(attach))), F.lit("]}}"))
    payload = F.struct(
        F.when(top_level, F.lit("text/plain")).otherwise(F.lit("multipart/mixed")).alias("mimeType"),
        headers.alias("headers"),
        F.when(top_level, F.struct(data.alias("data"), size.alias("size")))
         .otherwise(F.struct(F.lit(None).cast("string").alias("data"), F.lit(0).alias("size"))).alias("body"),
    )
    doc = F.struct(
        F.col("message_id").alias("id"),
        F.col("thread_id").alias("threadId"),
        F.when(eid % 23 != 0, F.col("size")).alias("sizeEstimate"),
        F.when(eid % 13 != 5, F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string")).alias("internalDate"),
        F.when(eid % 29 != 0, ids).alias("labelIds"),
        payload.alias("payload"),
    )
    f = f.select("event_id", F.to_json(doc).alias("_js"), F.when(F.coalesce(~top_level, F.lit(False)), parts).alias("_parts"))
    js = F.col("_js")
    js = F.when(F.col("_parts").isNull(), js).otherwise(F.concat(F.substr(js, F.lit(1), F.length(js) - 2), F.col("_parts")))
    value = F.when(eid % 100 == 37, F.substring("_js", 1, 80)).otherwise(js)
    return f.select(value.alias("value"), "event_id") if keep_key else f.select(value.alias("value"))
