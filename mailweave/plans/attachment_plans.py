"""Attachment queries over the landed ``att`` fixture (documents + pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attachments as AT
from ..sources import fixtures as fx
from .registry import register
from .sqlfrag import M

ATT = """att AS (
  SELECT concat('m', doc_id) AS message_id,
    concat('report ', doc_id, '.', ['pdf', 'txt', 'docx', 'exe'][doc_id % 4 + 1]) AS filename,
    coalesce(text, '') AS content,
    TIMESTAMP '2024-01-01' - to_days(CAST(doc_id % 400 AS INTEGER)) AS mtime FROM documents
  UNION ALL
  SELECT concat('p', page_id), concat('page ', page_id, '.html'), coalesce(html, ''),
    TIMESTAMP '2024-01-01' - to_days(CAST(page_id % 400 AS INTEGER)) FROM pages),
a AS (SELECT *, concat('att/', message_id, '/', filename) AS path, CAST(strlen(content) AS BIGINT) AS size,
    lower(regexp_extract(filename, '\\.([^./\\\\]+)$', 1)) AS ext FROM att),
am AS (SELECT *, CASE WHEN starts_with(content, '%PDF-') THEN 'application/pdf'
    WHEN starts_with(lower(ltrim(content)), '<!doctype html') OR starts_with(lower(ltrim(content)), '<html')
      THEN 'text/html'
    ELSE coalesce(CASE ext WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain'
      WHEN 'html' THEN 'text/html'
      WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      WHEN 'exe' THEN 'application/x-msdownload' END, 'application/octet-stream') END AS mime_type FROM a)"""


def sql(body: str) -> str:
    return f"WITH {ATT}\n{body}"


def _att(spark, sf):
    return fx.attachments_landed(spark, sf)


@register("attachment_meta", sql("""SELECT message_id, path, size, ext AS extension, md5(content) AS md5,
  sha256(content) AS sha256, concat_ws('_', message_id, substr(md5(content), 1, 8), filename) AS unique_name,
  mime_type FROM am"""))
def q_attachment_meta(spark, sf):
    return AT.enrich(_att(spark, sf)).select("message_id", "path", "size", "extension", "md5", "sha256",
                                             "unique_name", "mime_type")


@register("attachment_mime", sql("SELECT path, mime_type FROM am"))
def q_attachment_mime(spark, sf):
    return AT.enrich(_att(spark, sf)).select("path", "mime_type")


@register("attachment_text", sql("""SELECT path, CASE WHEN starts_with(mime_type, 'text/') THEN content END
  AS extracted_text FROM am"""))
def q_attachment_text(spark, sf):
    return AT.enrich(_att(spark, sf)).select("path", "extracted_text")


@register("attachment_filter", sql("""SELECT path FROM a WHERE size <= 20971
  AND ext IN ('pdf', 'doc', 'docx', 'txt', 'jpg', 'jpeg', 'png', 'gif')"""))
def q_attachment_filter(spark, sf):
    return AT.admissible(_att(spark, sf), max_size_mb=0.02).select("path")


@register("attachment_stats", sql("""SELECT CASE WHEN ext <> '' THEN concat('.', ext) ELSE '' END AS extension,
  count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes FROM a GROUP BY 1"""))
def q_attachment_stats(spark, sf):
    return AT.stats_by_extension(_att(spark, sf))


@register("attachment_totals", sql("""SELECT count(*) AS total_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size,
  round(CAST(coalesce(sum(size), 0) AS BIGINT) / 1048576, 2) AS total_size_mb FROM a"""))
def q_attachment_totals(spark, sf):
    return AT.stats_totals(_att(spark, sf))


@register("attachment_search", sql("SELECT path FROM a WHERE lower(filename) LIKE '%report 1%'"))
def q_attachment_search(spark, sf):
    return AT.search_by_name(_att(spark, sf), "REPORT 1").select("path")


@register("attachment_search_mime", sql("SELECT path FROM am WHERE mime_type LIKE '%text/%'"))
def q_attachment_search_mime(spark, sf):
    return AT.search_by_mime(_att(spark, sf), "text/").select("path")


@register("attachment_search_size", sql("SELECT path FROM a WHERE size >= 1000 AND size <= 5000"))
def q_attachment_search_size(spark, sf):
    return AT.search_by_size(_att(spark, sf), 1000, 5000).select("path")


@register("attachment_duplicates", sql("""SELECT message_id, path, md5(content) AS md5,
  count(*) OVER (PARTITION BY md5(content)) AS copies FROM a QUALIFY copies > 1"""))
def q_attachment_duplicates(spark, sf):
    return AT.duplicates(_att(spark, sf)).select("message_id", "path", "md5", "copies")


@register("attachment_expired", sql("""SELECT path FROM a
  WHERE mtime < TIMESTAMP '2024-02-01' - INTERVAL 90 DAY"""))
def q_attachment_expired(spark, sf):
    return AT.expired(_att(spark, sf), fx.AS_OF, 90).select("path")


@register("attachment_counts", f"""WITH {M}, {ATT}
SELECT m.message_id, CAST(count(att.message_id) AS BIGINT) AS attachment_count
FROM m LEFT JOIN att ON m.message_id = att.message_id GROUP BY m.message_id""")
def q_attachment_counts(spark, sf):
    return AT.attachment_counts(fx.messages(spark, sf, text=False).select("message_id"), _att(spark, sf))


@register("attachment_names", f"""WITH {M}
SELECT message_id,
  CASE event_id % 4 WHEN 0 THEN 'a<b>:c ' || event_id || '.pdf' WHEN 1 THEN 'x?y ' || event_id || '.txt'
       WHEN 2 THEN 'z* ' || event_id || '.png' ELSE 'attachment.pdf' END AS filename,
  translate(CASE event_id % 4 WHEN 0 THEN 'a<b>:c ' || event_id || '.pdf' WHEN 1 THEN 'x?y ' || event_id || '.txt'
       WHEN 2 THEN 'z* ' || event_id || '.png' ELSE 'attachment.pdf' END, '<>:"/\\|?*', '_________') AS safe_name
FROM m""")
def q_attachment_names(spark, sf):
    from ..operators.parse import attachment_filename
    f = fx.flat_messages(spark, sf)
    e = F.col("event_id")
    hdr = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    fname = F.when(e % 4 == 0, F.concat(F.lit("a<b>:c "), e, F.lit(".pdf")))
    headers = F.array(
        hdr("Content-Disposition", F.when(e % 4 == 1, F.concat(F.lit('attachment; filename="x?y '), e,
                                                               F.lit('.txt"'))).otherwise(F.lit("attachment"))),
        hdr("Content-Type", F.when(e % 4 == 2, F.concat(F.lit('image/png; name="z* '), e, F.lit('.png"')))
            .otherwise(F.lit("application/pdf"))))
    mime = F.when(e % 4 == 2, F.lit("image/png")).otherwise(F.lit("application/pdf"))
    name = attachment_filename(fname, headers, mime)
    return f.select("message_id", name.alias("filename"), AT.safe_name(name).alias("safe_name"))
