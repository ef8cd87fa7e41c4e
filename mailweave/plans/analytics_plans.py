"""Aggregation, top-k and window queries over the derived ``messages``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..session import landed, scratch_path
from ..sources import fixtures as fx
from .registry import register
from .sqlfrag import AS_OF, AS_OF_ORDERS, LABELS, ORDERS_TL, with_m

RANGE_START = _dt.datetime(2024, 1, 10)
RANGE_END = _dt.datetime(2024, 1, 20, 12, 0, 0)


def _m(spark, sf):
    return fx.messages(spark, sf, text=False)


BASIC_SQL = """SELECT count(*) AS total_messages, count_if(is_outgoing) AS total_sent,
  count_if(NOT is_outgoing) AS total_received, count_if(NOT is_read) AS total_unread,
  CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size_bytes,
  round(CAST(coalesce(sum(size), 0) AS BIGINT) / 1048576, 2) AS total_size_mb,
  round(coalesce(avg(size), 0) / 1024, 2) AS avg_message_size_kb,
  CAST(coalesce(avg(size), 0) AS DOUBLE) AS avg_size_bytes,
  min(timestamp) AS min_date, max(timestamp) AS max_date
FROM live"""


@register("basic_metrics", with_m(BASIC_SQL))
def q_basic_metrics(spark, sf):
    return A.basic_metrics(_m(spark, sf))


@register("basic_metrics_range", with_m(
    BASIC_SQL + " WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00'"
                " AND timestamp <= TIMESTAMP '2024-01-20 12:00:00'"))
def q_basic_metrics_range(spark, sf):
    return A.basic_metrics(_m(spark, sf), RANGE_START, RANGE_END)


CONTACTS_SQL = f"""SELECT email, coalesce(nullif(name, ''), email, '') AS name, total_messages,
  sent_count, received_count, last_contact, avg_size,
  round(total_messages / (floor((epoch_us({AS_OF}) - epoch_us(last_contact)) / 86400000000) + 1), 4)
    AS contact_frequency_score
FROM (SELECT sender_email AS email, count(*) AS total_messages,
        count_if(is_outgoing) AS sent_count, count_if(NOT is_outgoing) AS received_count,
        max(timestamp) AS last_contact, first(sender_name ORDER BY timestamp DESC, message_id DESC) AS name,
        CAST(avg(size) AS DOUBLE) AS avg_size
      FROM live WHERE sender_email IS NOT NULL AND sender_email <> ''
      GROUP BY sender_email HAVING count(*) >= 2
      ORDER BY total_messages DESC, email LIMIT 50) s"""


@register("contacts", with_m(CONTACTS_SQL))
def q_contacts(spark, sf):
    return A.contacts(_m(spark, sf), 50, fx.AS_OF)


@register("contact_frequency", with_m(
    f"SELECT email, total_messages, last_contact, contact_frequency_score FROM ({CONTACTS_SQL}) c"))
def q_contact_frequency(spark, sf):
    return A.contacts(_m(spark, sf), 50, fx.AS_OF).select(
        "email", "total_messages", "last_contact", "contact_frequency_score")


@register("contact_summary", with_m("""SELECT sender_email AS email, first(sender_name ORDER BY timestamp DESC, message_id DESC) AS name,
  count(*) AS total_messages, count_if(is_outgoing) AS sent_count, count_if(NOT is_outgoing) AS received_count,
  max(timestamp) AS last_contact, CAST(sum(size) AS BIGINT) AS total_size, CAST(avg(size) AS DOUBLE) AS avg_size
FROM live WHERE sender_email IS NOT NULL AND sender_email <> ''
GROUP BY sender_email ORDER BY total_messages DESC, email LIMIT 100"""))
def q_contact_summary(spark, sf):
    return A.contact_summary(_m(spark, sf), 100)


@register("top_senders", with_m("""SELECT sender_email AS email, count(*) AS message_count,
  CAST(sum(size) AS BIGINT) // 1024 // 1024 AS total_mb FROM m GROUP BY sender_email"""))
def q_top_senders(spark, sf):
    return A.top_senders(_m(spark, sf))


@register("peak_hours", with_m("""SELECT CAST(hour(timestamp) AS BIGINT) AS hour, count(*) AS count
FROM live GROUP BY 1 ORDER BY count DESC, hour LIMIT 3"""))
def q_peak_hours(spark, sf):
    return A.peak_hours(_m(spark, sf))


@register("hour_histogram", with_m("""SELECT CAST(hour(timestamp) AS BIGINT) AS hour, count(*) AS count
FROM live GROUP BY 1"""))
def q_hour_histogram(spark, sf):
    return A.hour_histogram(_m(spark, sf))


@register("peak_days", with_m("""SELECT CAST(dayofweek(timestamp) AS BIGINT) AS day_of_week,
  dayname(timestamp) AS day_name, count(*) AS count
FROM live GROUP BY 1, 2 ORDER BY count DESC, day_of_week LIMIT 3"""))
def q_peak_days(spark, sf):
    return A.peak_days(_m(spark, sf))


def _monthly_sql(src: str, as_of: str) -> str:
    return f"""SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS count FROM {src}
WHERE NOT is_deleted AND timestamp >= CAST(CAST({as_of} AS DATE) - INTERVAL 24 MONTH AS TIMESTAMP)
GROUP BY 1 ORDER BY 1"""


@register("monthly_trend", with_m(_monthly_sql("m", AS_OF)))
def q_monthly_trend(spark, sf):
    return A.monthly_trend(_m(spark, sf), fx.AS_OF)


@register("monthly_trend_orders", with_m(_monthly_sql("ot", AS_OF_ORDERS), ORDERS_TL))
def q_monthly_trend_orders(spark, sf):
    return A.monthly_trend(fx.order_timeline(spark, sf), fx.AS_OF_ORDERS)


@register("yearly_trend", with_m("""SELECT CAST(year(timestamp) AS BIGINT) AS year, count(*) AS count
FROM live GROUP BY 1 ORDER BY 1"""))
def q_yearly_trend(spark, sf):
    return A.yearly_trend(_m(spark, sf))


@register("yearly_trend_orders", with_m("""SELECT CAST(year(timestamp) AS BIGINT) AS year, count(*) AS count
FROM ot WHERE NOT is_deleted GROUP BY 1 ORDER BY 1""", ORDERS_TL))
def q_yearly_trend_orders(spark, sf):
    return A.yearly_trend(fx.order_timeline(spark, sf))


@register("label_distribution", with_m(f"""SELECT label, count(*) AS count
FROM (SELECT unnest({LABELS}) AS label FROM live) GROUP BY label ORDER BY count DESC, label LIMIT 20"""))
def q_label_distribution(spark, sf):
    return A.label_distribution(_m(spark, sf))


@register("size_analysis", with_m("""SELECT round(coalesce(avg(size), 0) / 1024, 2) AS avg_size_kb,
  CAST(coalesce(min(size), 0) AS BIGINT) AS min_size_bytes,
  round(coalesce(max(size), 0) / 1048576, 2) AS max_size_mb,
  CAST(avg(size) AS DOUBLE) AS avg_size,
  count_if(size < 1024) AS very_small, count_if(size BETWEEN 1024 AND 10240) AS small,
  count_if(size BETWEEN 10240 AND 102400) AS medium, count_if(size BETWEEN 102400 AND 1048576) AS large,
  count_if(size > 1048576) AS very_large
FROM live"""))
def q_size_analysis(spark, sf):
    return A.size_analysis(_m(spark, sf))


THREADS = """t AS (SELECT thread_id, count(*) AS message_count, count(DISTINCT sender_email) AS participant_count,
  min(timestamp) AS thread_start, max(timestamp) AS thread_end FROM {src} GROUP BY thread_id)"""


@register("thread_stats", with_m("SELECT * FROM t", THREADS.format(src="live")))
def q_thread_stats(spark, sf):
    return A.thread_stats(_m(spark, sf))


@register("thread_analysis", with_m("""SELECT count(*) AS total_threads,
  avg(message_count) AS avg_messages_per_thread,
  CAST(coalesce(max(message_count), 0) AS BIGINT) AS max_messages_in_thread,
  avg(participant_count) AS avg_participants_per_thread,
  count_if(message_count = 1) AS single_message_threads,
  count_if(message_count > 10) AS long_threads_10plus FROM t""", THREADS.format(src="live")))
def q_thread_analysis(spark, sf):
    return A.thread_analysis(_m(spark, sf))


@register("complex_threads", with_m("""SELECT thread_id, message_count, participant_count AS participants,
  thread_start, thread_end FROM t WHERE message_count > 5""", THREADS.format(src="m")))
def q_complex_threads(spark, sf):
    return A.complex_threads(_m(spark, sf))


@register("hourly_size", with_m("""SELECT CAST(hour(timestamp) AS BIGINT) AS hour,
  CAST(avg(size) AS DOUBLE) AS avg_size, count(*) AS count FROM m GROUP BY 1 ORDER BY 1"""))
def q_hourly_size(spark, sf):
    return A.hourly_size(_m(spark, sf))


@register("indexed_range", with_m("SELECT max(timestamp) AS newest, min(timestamp) AS oldest FROM m"))
def q_indexed_range(spark, sf):
    return A.indexed_range(_m(spark, sf))


# ---------------------------------------------------------------- metrics
def _metrics_cte(period: str) -> str:
    return f"""g AS (SELECT {period} AS date,
  CAST(count(*) AS DOUBLE) AS total_messages, CAST(count_if(is_outgoing) AS DOUBLE) AS total_sent,
  CAST(count_if(NOT is_outgoing) AS DOUBLE) AS total_received, CAST(count_if(NOT is_read) AS DOUBLE) AS total_unread,
  round(sum(size) / 1048576, 2) AS total_size_mb, round(avg(size) / 1024, 2) AS avg_message_size_kb
  FROM live GROUP BY 1),
metrics AS (SELECT date, metric_name, metric_value FROM (UNPIVOT g ON total_messages, total_sent, total_received,
  total_unread, total_size_mb, avg_message_size_kb INTO NAME metric_name VALUE metric_value))"""


DAY = "CAST(timestamp AS DATE)"
WEEK = "CAST(date_trunc('week', timestamp) AS DATE)"
MONTH = "CAST(date_trunc('month', timestamp) AS DATE)"


@register("daily_metrics", with_m("SELECT * FROM metrics", _metrics_cte(DAY)))
def q_daily_metrics(spark, sf):
    return A.daily_metrics(_m(spark, sf))


@register("weekly_metrics", with_m("SELECT * FROM metrics", _metrics_cte(WEEK)))
def q_weekly_metrics(spark, sf):
    return A.weekly_metrics(_m(spark, sf))


@register("monthly_metrics", with_m("SELECT * FROM metrics", _metrics_cte(MONTH)))
def q_monthly_metrics(spark, sf):
    return A.monthly_metrics(_m(spark, sf))


@register("metric_history", with_m(f"""SELECT date, metric_value FROM metrics
WHERE metric_name = 'total_messages' AND date >= CAST({AS_OF} AS DATE) - INTERVAL 14 DAY ORDER BY date""",
                                   _metrics_cte(DAY)))
def q_metric_history(spark, sf):
    return A.metric_history(A.daily_metrics(_m(spark, sf)), "total_messages", 14, fx.AS_OF)


@register("metric_retention", with_m(f"""SELECT * FROM metrics
WHERE date >= CAST({AS_OF} AS DATE) - INTERVAL 20 DAY""", _metrics_cte(DAY)))
def q_metric_retention(spark, sf):
    return A.metric_retention(A.daily_metrics(_m(spark, sf)), fx.AS_OF, 20)


@register("metrics_upsert", with_m("SELECT date, metric_name, metric_value FROM metrics", _metrics_cte(DAY)))
def q_metrics_upsert(spark, sf):
    """A stored history of stale values and of a few right ones; the days are collected
    anew in two runs, the second of which repeats some of the first's."""
    path = scratch_path(spark, "metrics")
    daily, _ = landed(A.daily_metrics(_m(spark, sf)), "metrics", "daily")
    odd = F.dayofmonth("date") % 2 == 1
    A.store_metrics(daily.withColumn("metric_value", F.when(F.col("metric_name") == "total_sent", F.col("metric_value")).otherwise(F.col("metric_value") - 1)), path)
    A.store_metrics(daily.filter(odd), path)
    A.store_metrics(daily.filter(~odd | (F.dayofmonth("date") == 3)).filter("metric_name <> 'total_sent'"), path)
    return A.read_metrics(spark, path)


# -------------------------------------------------------------- windows
REPLIES = """r AS (SELECT thread_id, prev_id AS incoming_id, message_id AS reply_id, prev_email AS email,
  (epoch_us(timestamp) - epoch_us(prev_ts)) / 3600e6 AS response_hours,
  epoch_us(timestamp) - epoch_us(prev_ts) AS response_micros
FROM (SELECT thread_id, message_id, timestamp, is_outgoing,
        lag(timestamp) OVER w AS prev_ts, lag(is_outgoing) OVER w AS prev_out,
        lag(sender_email) OVER w AS prev_email, lag(message_id) OVER w AS prev_id
      FROM live WINDOW w AS (PARTITION BY thread_id ORDER BY timestamp, message_id))
WHERE is_outgoing AND NOT prev_out)"""


@register("replies", with_m("SELECT * FROM r", REPLIES))
def q_replies(spark, sf):
    return A.replies(_m(spark, sf))


@register("contact_response", with_m("""SELECT email, avg(response_micros) / 3600e6 AS avg_response_hours,
  count(*) AS replies FROM r WHERE email IS NOT NULL AND email <> '' GROUP BY email""", REPLIES))
def q_contact_response(spark, sf):
    return A.contact_response(_m(spark, sf))


@register("response_stats", with_m("""SELECT coalesce(avg(response_micros) / 3600e6, 0.0) AS avg_response_hours,
  coalesce(median(response_hours), 0.0) AS median_response_hours, count(*) AS replied,
  count(*) * 100.0 / nullif((SELECT count_if(NOT is_outgoing) FROM live), 0) AS response_rate_percentage
FROM r""", REPLIES))
def q_response_stats(spark, sf):
    return A.response_stats(_m(spark, sf))


def _section(name: str, body: str, key: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS section, {key} AS key, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM ({body})"
                              for m, e in metrics.items())


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


REPORT_SQL = with_m(" UNION ALL ".join([
    _section("basic_metrics", BASIC_SQL, "''", {**_same("total_messages", "total_sent", "total_received", "total_unread",
             "total_size_bytes", "total_size_mb", "avg_message_size_kb"),
             "min_date": "epoch_us(min_date)", "max_date": "epoch_us(max_date)"}),
    _section("top_contacts", CONTACTS_SQL.replace("LIMIT 50", "LIMIT 10"), "email",
             {**_same("total_messages", "sent_count", "received_count", "contact_frequency_score"), "last_contact": "epoch_us(last_contact)"}),
    _section("peak_hours", "SELECT CAST(hour(timestamp) AS VARCHAR) AS k, count(*) AS n, hour(timestamp) AS h FROM live "
             "GROUP BY ALL ORDER BY n DESC, h LIMIT 3", "k", {"count": "n"}),
    _section("peak_days", "SELECT CAST(dayofweek(timestamp) AS VARCHAR) AS k, count(*) AS n FROM live GROUP BY ALL "
             "ORDER BY n DESC, k LIMIT 3", "k", {"count": "n"}),
    _section("monthly_trends", f"SELECT strftime(timestamp, '%Y-%m') AS k, count(*) AS n FROM live "
             f"WHERE timestamp >= {AS_OF} - INTERVAL 24 MONTH GROUP BY ALL", "k", {"count": "n"}),
    _section("yearly_trends", "SELECT CAST(year(timestamp) AS VARCHAR) AS k, count(*) AS n FROM live GROUP BY ALL", "k", {"count": "n"}),
    _section("label_distribution", f"SELECT label, count(*) AS n FROM (SELECT unnest({LABELS}) AS label FROM live) "
             "GROUP BY label ORDER BY n DESC, label LIMIT 20", "label", {"count": "n"}),
    _section("size_analysis", "SELECT * FROM live", "''", {
        "min_size_bytes": "min(size)", "max_size_mb": "round(max(size) / 1048576, 2)", "very_small": "count_if(size < 1024)",
        "small": "count_if(size BETWEEN 1024 AND 10240)", "medium": "count_if(size BETWEEN 10240 AND 102400)",
        "large": "count_if(size BETWEEN 102400 AND 1048576)", "very_large": "count_if(size > 1048576)"}),
    _section("response_stats", "SELECT * FROM r", "''", {
        "avg_response_hours": "coalesce(avg(response_micros) / 3600e6, 0)",
        "median_response_hours": "coalesce(median(response_hours), 0)", "replied": "count(*)"}),
]), REPLIES)


@register("summary_report", REPORT_SQL)
def q_summary_report(spark, sf):
    from ..operators import report as R
    path = R.write_report(R.summary_report(_m(spark, sf), fx.AS_OF), scratch_path(spark, "report"))   # A18
    return R.read_report(spark, path).where("section <> 'thread_analysis'")
