"""Attachment jobs (M2-M15, E6) over a ``binaryFile``-shaped frame:
``path, modificationTime, length, content`` plus ``message_id`` and
``filename``. Hashing, sniffing and decoding are built-in expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, functions as F

from ..session import landed

# Default attachment limits (size in MB, allowed extensions).
MAX_SIZE_MB = 100
ALLOWED_TYPES = ["pdf", "doc", "docx", "txt", "jpg", "jpeg", "png", "gif"]

# Characters replaced by '_' in stored file names.
UNSAFE_CHARS = '<>:"/\\|?*'

# Leading-byte signatures (hex) → MIME type.
MAGIC = [("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"),
         ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("504B0304", "application/zip")]

# Extension → MIME type when the content says nothing.
EXT_MIME = {
    "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "htm": "text/html",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "gif": "image/gif", "zip": "application/zip", "exe": "application/x-msdownload", "csv": "text/csv",
}


def extension(name: Column) -> Column:
    """Lower-case extension without the dot ('' when none)."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def safe_name(name: Column) -> Column:
    """M6: unsafe characters → '_'; longer than 255 → cut the stem, keep
    the extension."""
    s = F.translate(name, UNSAFE_CHARS, "_" * len(UNSAFE_CHARS))
    ext = F.regexp_extract(s, r"(\.[^.]*)$", 1)
    return F.when(F.length(s) > 255,
                  F.concat(F.substring(s, F.lit(1), F.lit(255) - F.length(ext)), ext)).otherwise(s)


def sniff_mime(content: Column, name: Column) -> Column:
    """M7: content signature, then the file extension, else octet-stream."""
    head = F.hex(F.substring(content, 1, 16))
    txt = F.lower(F.substring(F.ltrim(content.cast("string"), F.lit(" \t\r\n\f\v")), 1, 16))
    by_magic = F.coalesce(*[F.when(head.startswith(h), F.lit(m)) for h, m in MAGIC],
                          F.when(txt.startswith("<!doctype html") | txt.startswith("<html"), F.lit("text/html")))
    by_ext = F.element_at(F.create_map(*[F.lit(x) for kv in EXT_MIME.items() for x in kv]), extension(name))
    return F.coalesce(by_magic, by_ext, F.lit("application/octet-stream"))


def text_content(content: Column, mime: Column) -> Column:
    """M9: text of ``text/*`` files: UTF-16 by BOM, else UTF-8 when valid,
    else Latin-1 (which never fails)."""
    bom = F.hex(F.substring(content, 1, 2))
    as_text = (F.when(bom.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
                .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
                .otherwise(F.decode(content, "ISO-8859-1")))
    return F.when(mime.startswith("text/"), as_text)


def enrich(att: DataFrame) -> DataFrame:
    """M5-M9: hashes, safe and unique names, MIME type, extracted text."""
    md5 = F.md5("content")
    mime = sniff_mime(F.col("content"), F.col("filename"))
    return att.select(
        "message_id", "path", "filename", F.col("length").alias("size"), "modificationTime",
        extension(F.col("filename")).alias("extension"),
        md5.alias("md5"), F.sha2("content", 256).alias("sha256"),
        safe_name(F.col("filename")).alias("safe_name"),
        F.concat_ws("_", "message_id", F.substring(md5, 1, 8), safe_name(F.col("filename"))).alias("unique_name"),
        mime.alias("mime_type"),
        text_content(F.col("content"), mime).alias("extracted_text"),
    )


def admissible(att: DataFrame, max_size_mb: float = MAX_SIZE_MB, allowed=ALLOWED_TYPES) -> DataFrame:
    """M3/M4: within the size limit and of an allowed type."""
    limit = int(max_size_mb * 1024 * 1024)
    return att.filter((F.col("length") <= limit) & extension(F.col("filename")).isin(*allowed))


def stats_by_extension(att: DataFrame) -> DataFrame:
    """Files and bytes per extension (with the dot, '' when none)."""
    ext = F.when(extension(F.col("filename")) != "", F.concat(F.lit("."), extension(F.col("filename")))) \
           .otherwise(F.lit(""))
    return att.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"),
                                                   F.sum("length").cast("bigint").alias("total_bytes"))


def stats_totals(att: DataFrame) -> DataFrame:
    """M10 totals."""
    a = att.agg(F.count(F.lit(1)).alias("total_files"),
                F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_size"))
    return a.withColumn("total_size_mb", F.round(F.col("total_size") / (1024 * 1024), 2))


def search_by_name(att: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """M11."""
    if case_sensitive:
        return att.filter(F.col("filename").contains(pattern))
    return att.filter(F.lower("filename").contains(pattern.lower()))


def search_by_mime(att: DataFrame, mime: str) -> DataFrame:
    """Substring of the detected type."""
    return att.filter(sniff_mime(F.col("content"), F.col("filename")).contains(mime))


def search_by_size(att: DataFrame, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """Inclusive range, open upper end when ``max_size`` is None."""
    p = F.col("length") >= min_size
    if max_size is not None:
        p = p & (F.col("length") <= max_size)
    return att.filter(p)


def duplicates(att: DataFrame) -> DataFrame:
    """Every file whose content hash occurs more than once, with the
    copy count. Counts come from a map-side pre-aggregated ``groupBy`` (a
    hot hash costs one row per task); the join back is a plain equi-join
    that AQE's skew handling splits if one hash holds many files. No group
    is ever collected into a list."""
    h, _ = landed(att.select("message_id", "path", F.md5("content").alias("md5")), "hashes")   # contents are hashed once
    counts = h.groupBy("md5").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    return h.join(counts, "md5")


def expired(att: DataFrame, as_of: _dt.datetime, days_old: int = 90) -> DataFrame:
    """Files older than ``days_old`` days (the list only)."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days_old))
    return att.filter(F.col("modificationTime").cast("timestamp_ntz") < cutoff)


def attachment_counts(messages: DataFrame, att: DataFrame) -> DataFrame:
    """``attachment_count`` per message (0 when none); attachments are
    aggregated per message before the join."""
    per = att.groupBy("message_id").agg(F.count(F.lit(1)).alias("_n"))
    return (messages.join(per, "message_id", "left")
                    .withColumn("attachment_count", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n"))
