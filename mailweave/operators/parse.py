"""Raw message JSON → typed ``messages`` rows.

The raw text is parsed once into a ``VARIANT`` column; every field is a
``try_variant_get`` path. The recursive MIME tree is walked level by level
with an ``aggregate`` *inside each row* that runs as often as the row has
``parts``, so any depth is reached without an explode, a shuffle or a driver
loop, and parsing stays a single narrow stage that scales with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.addresses import parse_address, parse_address_list
from ..functions.dates import from_epoch_millis, parse_rfc2822
from ..functions.mime import SUPPORTED_BODY_TYPES, b64url_decode
from ..functions.text import html_to_text
from ..schema import conform

HEADERS_T = "array<struct<name:string,value:string>>"


def header(headers: Column, name: str) -> Column:
    """Case-insensitive header pick, the **last** occurrence wins."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(hits, F.lit(-1))["value"]


NODES_T = "array<struct<path:array<int>,top:string,node:variant>>"
WALK_T = f"struct<done:{NODES_T},open:{NODES_T}>"


def _children(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _nesting(value: Column) -> Column:
    """An upper bound of a message's MIME depth: its ``"parts"`` keys, or, where
    the text holds escapes that could spell the key, its objects."""
    count = lambda what: ((F.length(value) - F.length(F.replace(value, F.lit(what), F.lit("")))) / len(what)).cast("int")
    return F.when(F.contains(value, F.lit("\\u00")), count("{")).otherwise(count('"parts"'))


def part_nodes(v: Column, value: Column) -> Column:
    """Every part of the tree as ``struct(path, top, node)``: ``path`` is the
    chain of sibling indexes (arrays compare in depth-first pre-order), ``top``
    the MIME type of the top-level ancestor. Null for unparseable rows."""
    first = F.transform(_children(v, "$.payload.parts"), lambda p, i: F.struct(
        F.array(i).alias("path"), F.try_variant_get(p, "$.mimeType", "string").alias("top"), p.alias("node")))
    start = F.struct(F.array().cast(NODES_T).alias("done"), first.cast(NODES_T).alias("open")).cast(WALK_T)

    def deeper(walk, _):
        below = F.flatten(F.transform(walk["open"], lambda x: F.transform(
            _children(x["node"], "$.parts"), lambda c, j: F.struct(
                F.concat(x["path"], F.array(j)).alias("path"), x["top"].alias("top"), c.alias("node")))))
        return F.struct(F.concat(walk["done"], walk["open"]).alias("done"), below.cast(NODES_T).alias("open")).cast(WALK_T)
    return F.when(v.isNotNull(), F.aggregate(F.sequence(F.lit(0), _nesting(value)), start, deeper,
                                             lambda walk: F.concat(walk["done"], walk["open"])))


def path_text(path: Column) -> Column:
    """``[0, 1]`` → ``0000.0001``; longer indexes are written whole."""
    return F.array_join(F.transform(path, lambda i: F.when(i < 10000, F.lpad(i.cast("string"), 4, "0"))
                                    .otherwise(i.cast("string"))), ".")


def top_text(v: Column) -> Column:
    """The decoded top-level ``body.data``, before HTML stripping."""
    return b64url_decode(F.try_variant_get(v, "$.payload.body.data", "string"))


def select_part(nodes: Column) -> Column:
    """Where no top-level text is: among top-level parts of a supported type in
    order, the first depth-first non-empty data that decodes. Candidates are sorted by
    path, and the fold decodes each at most once and none after the first success.
    Returns struct(path, text): the chosen part's, before HTML stripping."""
    cands = F.array_sort(F.filter(
        F.transform(nodes, lambda n: F.struct(n["path"].alias("path"),
                                              F.try_variant_get(n["node"], "$.body.data", "string").alias("data"),
                                              n["top"].alias("top"))),
        lambda c: c["data"].isNotNull() & (c["data"] != "") & F.coalesce(c["top"].isin(*SUPPORTED_BODY_TYPES),
                                                                           F.lit(False))))
    none = F.lit(None).cast("struct<path:array<int>,text:string>")
    decoded = lambda c: F.try_element_at(F.filter(F.transform(
        F.array(b64url_decode(c["data"])), lambda t: F.struct(c["path"].alias("path"), t.alias("text"))),
        lambda x: F.length(x["text"]) > 0), F.lit(1))
    return F.aggregate(cands, none, lambda acc, c: F.coalesce(acc, decoded(c)))


def parse_variant(raw: DataFrame, labels: Column, value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The parse step: adds the typed columns and ``_reason`` (null when the
    row is good); columns of ``raw`` to ``keep`` come with them. Each expensive part is
    one column of its own projection."""
    d = raw.select(F.col(value_col), *keep, F.try_parse_json(F.col(value_col)).alias("_v"), labels.alias("_dict"))
    v, labels = F.col("_v"), F.col("_dict")
    d = d.select("*", part_nodes(v, F.col(value_col)).alias("_nodes"), top_text(v).alias("_top"),
                 F.coalesce(F.try_variant_get(v, "$.payload.headers", HEADERS_T),
                            F.array().cast(HEADERS_T)).alias("_headers"),
                 F.try_variant_get(v, "$.labelIds", "array<string>").alias("_ids"),
                 F.try_variant_get(v, "$.internalDate", "string").alias("_internal"))
    d = d.select("*", F.when(F.col("_top").isNull(), select_part(F.col("_nodes"))).alias("_part"),
                 *[header(F.col("_headers"), k).alias(f"_{k}") for k in ("from", "to", "cc", "bcc")])
    headers, ids, internal = F.col("_headers"), F.col("_ids"), F.col("_internal")
    date_hdrs = F.filter(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == "date"),
                                     lambda h: parse_rfc2822(h["value"])), lambda t: t.isNotNull())
    ts = F.when(internal.isNotNull(), from_epoch_millis(internal)) \
          .otherwise(F.try_element_at(date_hdrs, F.lit(1)))
    sender = parse_address(F.col("_from"))
    rcpt = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(k).alias("key"),
                 F.when(F.col(f"_{k}").isNotNull(), parse_address_list(F.col(f"_{k}"))).alias("value"))
        for k in ("to", "cc", "bcc")]), lambda e: e["value"].isNotNull()))
    text = F.coalesce("_top", "_part.text")
    parsed = d.select(
        F.col(value_col), *keep,
        F.try_variant_get(v, "$.id", "string").alias("message_id"),
        F.try_variant_get(v, "$.threadId", "string").alias("thread_id"),
        F.when(F.try_variant_get(v, "$.payload", "variant").isNull(), F.lit(None))
         .otherwise(F.coalesce(sender, F.struct(F.lit(None).cast("string").alias("name"),
                                               F.lit(None).cast("string").alias("email")))).alias("sender"),
        rcpt.alias("recipients"),
        F.when(ids.isNull(), F.array().cast("array<string>"))
         .otherwise(F.transform(F.filter(ids, lambda x: F.map_contains_key(labels, x)),
                                lambda x: F.element_at(labels, x))).alias("labels"),
        header(headers, "subject").alias("subject"),
        F.when(text.isNotNull(), html_to_text(text)).alias("body"),
        F.when(F.col("_top").isNotNull(), F.lit("payload"))
         .otherwise(path_text(F.col("_part.path"))).alias("body_path"),
        F.coalesce(F.try_variant_get(v, "$.sizeEstimate", "bigint"), F.lit(0).cast("bigint")).alias("size"),
        ts.alias("timestamp"),
        F.when(ids.isNull(), F.lit(False)).otherwise(~F.array_contains(ids, "UNREAD")).alias("is_read"),
        F.when(ids.isNull(), F.lit(False)).otherwise(F.array_contains(ids, "SENT")).alias("is_outgoing"),
        F.lit(False).alias("is_deleted"),
        v.isNull().alias("_broken"),
        F.spark_partition_id().alias("_barrier"),
    )
    # ``_reason`` reads ``_barrier``, which Catalyst may not move: so the split on
    # ``_reason`` filters columns that were computed once instead of being pushed
    # below the projection together with a second copy of the whole parse.
    reason = (F.when(F.col("_barrier") < 0, F.lit(None).cast("string"))
               .when(F.col("_broken"), F.lit("unparseable_json"))
               .when(F.col("message_id").isNull(), F.lit("missing_id"))
               .when(F.col("thread_id").isNull(), F.lit("missing_thread_id"))
               .when(F.col("timestamp").isNull(), F.lit("missing_timestamp")))
    return parsed.withColumn("_reason", reason).drop("_barrier", "_broken")


def parse_messages(raw: DataFrame, labels: Column, indexed_at=None) -> tuple[DataFrame, DataFrame]:
    """B1: (good rows as typed ``messages``, quarantine rows). A bad row
    never fails the job; it only lands in the quarantine frame."""
    p = parse_variant(raw, labels)
    now = F.current_timestamp().cast("timestamp_ntz") if indexed_at is None \
        else F.lit(indexed_at).cast("timestamp_ntz")
    good = conform(p.filter(F.col("_reason").isNull()).withColumn("last_indexed", now))
    bad = p.filter(F.col("_reason").isNotNull()).select("value", F.col("_reason").alias("reason"))
    return good, bad


def parts_table(raw: DataFrame) -> DataFrame:
    """One row per MIME part at any depth (explode happens only
    here, where a row per part is the requested output)."""
    d = raw.select("value", F.try_parse_json(F.col("value")).alias("_v"))
    d = d.select("_v", part_nodes(F.col("_v"), F.col("value")).alias("_nodes"))
    d = d.select(F.try_variant_get("_v", "$.id", "string").alias("message_id"),
                 F.col("_nodes"), F.spark_partition_id().alias("_barrier"))   # see parse_variant
    e = (d.filter(F.col("message_id").isNotNull() & (F.col("_barrier") >= 0))
          .select("message_id", F.explode("_nodes").alias("p")))
    field = lambda path, kind: F.try_variant_get("p.node", path, kind)  # noqa: E731  (of a part, and only if it is used)
    return e.select("message_id", path_text(F.col("p.path")).alias("path"), F.size("p.path").alias("depth"),
                    field("$.mimeType", "string").alias("mime_type"), field("$.body.data", "string").alias("data"),
                    field("$.body.attachmentId", "string").alias("attachment_id"), field("$.body.size", "bigint").alias("size"),
                    field("$.filename", "string").alias("filename"), field("$.headers", HEADERS_T).alias("headers"),
                    F.size(_children(F.col("p.node"), "$.parts")).alias("n_children"))


def attachment_parts(raw: DataFrame) -> DataFrame:
    """M1/M8: parts carrying an ``attachmentId`` with file name, inline flag
    and content id."""
    p = parts_table(raw).filter(F.col("attachment_id").isNotNull())
    disp = header(F.col("headers"), "content-disposition")
    return p.select("message_id", "path", "mime_type", "attachment_id", "size",
                    attachment_filename(F.col("filename"), F.col("headers"), F.col("mime_type")).alias("filename"),
                    F.coalesce(F.lower(disp).contains("inline"), F.lit(False)).alias("is_inline"),
                    header(F.col("headers"), "content-id").alias("content_id"))


# File extension for a MIME type when no name is given.
MIME_EXTENSIONS = {
    "application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif",
    "text/plain": ".txt", "text/html": ".html", "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/zip": ".zip",
}


def attachment_filename(filename: Column, headers: Column, mime_type: Column) -> Column:
    """M2: part file name, else Content-Disposition ``filename=``, else
    Content-Type ``name=``, else ``attachment`` + extension of the type (``.bin`` if unknown)."""
    disp = header(headers, "content-disposition")
    ctype = header(headers, "content-type")
    pat = lambda key: rf'(?i){key}\s*=\s*"?([^";]+)"?'
    ext = F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])
    return F.coalesce(
        F.nullif(filename, F.lit("")),
        F.nullif(F.regexp_extract(F.coalesce(disp, F.lit("")), pat("filename"), 1), F.lit("")),
        F.nullif(F.regexp_extract(F.coalesce(ctype, F.lit("")), pat("name"), 1), F.lit("")),
        F.concat(F.lit("attachment"), F.coalesce(F.element_at(ext, F.lower(mime_type)), F.lit(".bin"))),
    )
