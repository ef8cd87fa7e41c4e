"""Filter, search, sort and paging queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import substrings as SUB
from ..session import scratch_path
from ..sources import fixtures as fx
from .registry import register
from .sqlfrag import with_m

HIT_SQL = "message_id, thread_id, sender_email, size, timestamp"


def _hits(df):
    return df.select("message_id", "thread_id", F.col("sender.email").alias("sender_email"), "size", "timestamp")


def _m(spark, sf):
    return fx.messages(spark, sf)


def _run(spark, sf, **kw):
    page, _ = S.search(_m(spark, sf), S.build_query(**kw))
    return _hits(page)


def _sql(where: str, tail: str = "") -> str:
    return with_m(f"SELECT {HIT_SQL} FROM m WHERE ({where}) AND NOT is_deleted {tail}")


D = _dt.datetime


@register("filter_eq", _sql("lower(sender_email) = 'user5@mail0.example.com'"))
def q_filter_eq(spark, sf):
    return _run(spark, sf, filters=[dict(field="sender.email", operator="eq", value="USER5@mail0.example.com")])


@register("filter_ne", _sql("lower(sender_email) <> ''"))
def q_filter_ne(spark, sf):
    return _run(spark, sf, filters=[dict(field="sender.email", operator="ne", value="")])


@register("filter_range", _sql("size > 1000 AND size <= 50000 AND timestamp >= TIMESTAMP '2024-01-05'"
                               " AND timestamp < TIMESTAMP '2024-01-25'"))
def q_filter_range(spark, sf):
    return _run(spark, sf, filters=[
        dict(field="size", operator="gt", value=1000), dict(field="size", operator="le", value=50000),
        dict(field="timestamp", operator="ge", value=D(2024, 1, 5)),
        dict(field="timestamp", operator="lt", value=D(2024, 1, 25))])


@register("filter_like", _sql("lower(subject) ILIKE '%the%' AND NOT (lower(body) ILIKE '%zz%')"))
def q_filter_like(spark, sf):
    return _run(spark, sf, filters=[dict(field="subject", operator="like", value="%THE%"),
                                    dict(field="body", operator="not_like", value="%ZZ%")])


@register("filter_in", _sql("thread_id IN ('t0', 't1', 'l5', 's100', 'l12', 'T2') "
                            "AND message_id NOT IN ('m1', 'm2', 'm50')"))
def q_filter_in(spark, sf):
    return _run(spark, sf, filters=[
        dict(field="thread_id", operator="in", value=["t0", "t1", "l5", "s100", "l12", "T2"]),
        dict(field="message_id", operator="not_in", value=["m1", "m2", "m50"])])


@register("filter_between", _sql("size BETWEEN 1024 AND 10240"))
def q_filter_between(spark, sf):
    return _run(spark, sf, filters=[dict(field="size", operator="between", value=[1024, 10240])])


@register("filter_null", _sql("subject IS NULL AND body IS NOT NULL"))
def q_filter_null(spark, sf):
    return _run(spark, sf, filters=[dict(field="subject", operator="is_null"),
                                    dict(field="body", operator="is_not_null")])


COMBINED_WHERE = ("(lower(subject) LIKE '%the%' OR lower(body) LIKE '%the%') AND size >= 1000 AND is_outgoing = true"
                  " AND timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'")
COMBINED = dict(text="the", filters=[dict(field="size", operator="ge", value=1000),
                                     dict(field="is_outgoing", operator="eq", value=True)],
                date_range=(D(2024, 1, 3), D(2024, 1, 28)), sort_field="size", sort_order="ASC",
                limit=25, offset=5)


@register("search_combined", _sql(COMBINED_WHERE, "ORDER BY size ASC, message_id LIMIT 25 OFFSET 5"))
def q_search_combined(spark, sf):
    return _run(spark, sf, **COMBINED)


@register("search_total", with_m(f"SELECT count(*) AS total_count FROM m WHERE {COMBINED_WHERE} AND NOT is_deleted"))
def q_search_total(spark, sf):
    return S.total_count(_m(spark, sf), S.build_query(**COMBINED))


@register("text_like", _sql("lower(subject) LIKE '%the%' OR lower(body) LIKE '%the%'"))
def q_text_like(spark, sf):
    return _run(spark, sf, text="The")


def _trigrams(m, fields):
    return SUB.store_trigrams(m, scratch_path(m.sparkSession, "trigrams"), fields, buckets=16)


@register("text_like_indexed", _sql("lower(subject) LIKE '%enth%' OR lower(body) LIKE '%enth%'"))
def q_text_like_indexed(spark, sf):
    """C16 by trigrams instead of a scan."""
    m = _m(spark, sf)
    return _hits(SUB.containing(m, _trigrams(m, ("subject", "body")), "eNth").filter(~F.col("is_deleted")))


@register("search_date_range", _sql("timestamp BETWEEN TIMESTAMP '2024-01-07 06:00:00' AND TIMESTAMP '2024-01-09'"))
def q_search_date_range(spark, sf):
    return _hits(S.by_date_range(_m(spark, sf), D(2024, 1, 7, 6), D(2024, 1, 9)))


@register("search_sender", _sql("lower(sender_email) LIKE '%user14%' OR lower(sender_name) LIKE '%user14%'",
                                "ORDER BY timestamp DESC, message_id LIMIT 100"))
def q_search_sender(spark, sf):
    return _hits(S.by_sender(_m(spark, sf), "User14"))


@register("search_unread", _sql("is_read = false", "ORDER BY timestamp DESC, message_id LIMIT 100"))
def q_search_unread(spark, sf):
    return _hits(S.unread(_m(spark, sf)))


@register("search_large", _sql("size >= 524288"))
def q_search_large(spark, sf):
    return _hits(S.large(_m(spark, sf), 0.5))


@register("search_sorted", _sql("true", "ORDER BY subject ASC NULLS FIRST, message_id LIMIT 50"))
def q_search_sorted(spark, sf):
    return _run(spark, sf, sort_field="subject", sort_order="ASC", limit=50)


@register("search_offset", _sql("size >= 1000", "ORDER BY size, message_id OFFSET 40"))
def q_search_offset(spark, sf):
    return _run(spark, sf, filters=[dict(field="size", operator="ge", value=1000)], sort_field="size", sort_order="ASC", offset=40)


@register("search_page", _sql("true", "ORDER BY timestamp DESC, message_id LIMIT 50 OFFSET 100"))
def q_search_page(spark, sf):
    return _run(spark, sf, limit=50, offset=100)


def _sugg_sql(t: str, n: int) -> str:
    return with_m(f"""SELECT suggestion FROM (
  (SELECT DISTINCT subject AS suggestion FROM m WHERE subject IS NOT NULL AND subject <> ''
     AND lower(subject) LIKE '%{t}%' ORDER BY 1 LIMIT {n})
  UNION
  (SELECT DISTINCT sender_email FROM m WHERE sender_email IS NOT NULL AND sender_email <> ''
     AND lower(sender_email) LIKE '%{t}%' ORDER BY 1 LIMIT {n // 2})) u ORDER BY 1 LIMIT {n}""")


@register("suggestions", _sugg_sql("us", 10))
def q_suggestions(spark, sf):
    return S.suggestions(_m(spark, sf), "us", 10)


@register("suggestions_indexed", _sugg_sql("er1", 10))
def q_suggestions_indexed(spark, sf):
    """D9 by trigrams instead of a scan per keystroke."""
    m = _m(spark, sf)
    return SUB.suggestions(m, _trigrams(m, ("subject", "sender_email")), "Er1", 10)


EXPORT_FILTERS = dict(date_range=(D(2024, 1, 2), D(2024, 1, 29)), sender_email="mail1",
                      subject_contains="e", has_label="import", is_unread=False, min_size_mb=0.01)


@register("export_filtered", with_m(f"""SELECT {HIT_SQL} FROM m WHERE NOT is_deleted
  AND timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'
  AND lower(sender_email) LIKE '%mail1%' AND lower(subject) LIKE '%e%'
  AND len(list_filter([label_1, label_2, label_3], lambda x: lower(x) LIKE '%import%')) > 0
  AND is_read = true AND size >= 10485"""))
def q_export_filtered(spark, sf):
    return _hits(S.export_filters(_m(spark, sf), EXPORT_FILTERS))


@register("all_ids", with_m("SELECT message_id FROM m"))
def q_all_ids(spark, sf):
    return _m(spark, sf).select("message_id")


@register("param_sql", with_m("""SELECT thread_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM m
WHERE NOT is_deleted AND size > 5000 AND sender_email LIKE '%mail2%' GROUP BY thread_id"""))
def q_param_sql(spark, sf):
    return S.param_sql(spark, _m(spark, sf).select("thread_id", "size", "is_deleted", "sender"),
                       "SELECT thread_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM {messages} "
                       "WHERE NOT is_deleted AND size > ? AND sender.email LIKE ? GROUP BY thread_id",
                       [5000, "%mail2%"])
