"""Aggregations (F1-F26) and response-time windows.

All operators take a ``messages``-shaped DataFrame and return a small,
flat DataFrame. Aggregates are plain ``groupBy().agg()`` so Spark runs a
partial (map-side) aggregate before any shuffle; top-k uses
``orderBy().limit()`` which plans as ``TakeOrderedAndProject``. The
evaluation clock ``as_of`` is always explicit.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import folders, landed

MB = 1024 * 1024
KB = 1024


def live(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """The soft-delete guard."""
    return df if include_deleted else df.filter(~F.col("is_deleted"))


def date_window(df: DataFrame, start=None, end=None) -> DataFrame:
    """Open-ended inclusive date filter, each bound optional."""
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    return df


def _lit_ts(v) -> Column:
    return F.lit(v).cast("timestamp_ntz")


# ------------------------------------------------------------------ F1 / F2
def basic_metrics(df: DataFrame, start=None, end=None) -> DataFrame:
    """totals over live messages in an optional date range; nulls → 0."""
    base = date_window(live(df), start, end).select("is_outgoing", "is_read", "size", "timestamp")
    agg = base.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("is_outgoing")).alias("total_sent"),
        F.count_if(~F.col("is_outgoing")).alias("total_received"),
        F.count_if(~F.col("is_read")).alias("total_unread"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
        F.avg("size").alias("avg_size_bytes"),
        F.min("timestamp").alias("min_date"),
        F.max("timestamp").alias("max_date"),
    )
    return agg.select(
        "total_messages", "total_sent", "total_received", "total_unread", "total_size_bytes",
        F.round(F.col("total_size_bytes") / MB, 2).alias("total_size_mb"),
        F.round(F.coalesce(F.col("avg_size_bytes"), F.lit(0.0)) / KB, 2).alias("avg_message_size_kb"),
        F.coalesce(F.col("avg_size_bytes"), F.lit(0.0)).alias("avg_size_bytes"),
        "min_date", "max_date",
    )


# --------------------------------------------------------- F3 - F6, F15, F16
def _has_sender(df: DataFrame) -> DataFrame:
    """Sender e-mail neither null nor empty."""
    e = F.col("sender.email")
    return df.filter(e.isNotNull() & (e != ""))


def _sender_stats(df: DataFrame) -> DataFrame:
    base = _has_sender(live(df)).select(
        F.col("sender.email").alias("email"), F.col("sender.name").alias("_name"),
        "is_outgoing", "timestamp", "message_id", "size")
    return base.groupBy("email").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("is_outgoing")).alias("sent_count"),
        F.count_if(~F.col("is_outgoing")).alias("received_count"),
        F.max("timestamp").alias("last_contact"),
        F.max_by("_name", F.struct("timestamp", "message_id")).alias("name"),   # F4: name on the newest message
        F.sum("size").cast("bigint").alias("total_size"),
        F.avg("size").alias("avg_size"),
    )


def frequency_score(total: Column, last: Column, as_of) -> Column:
    """messages / (whole days since last contact + 1), 4 decimals."""
    secs = F.unix_timestamp(_lit_ts(as_of).cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    days = F.floor(secs / F.lit(86400))
    return F.round(total / (days + 1), 4)


def contacts(df: DataFrame, limit: int = 50, as_of=None) -> DataFrame:
    """per sender e-mail with at least two live messages, busiest first."""
    s = _sender_stats(df).filter(F.col("total_messages") >= 2)
    top = s.orderBy(F.col("total_messages").desc(), F.col("email").asc()).limit(limit)
    out = top.select(
        "email",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("email"), F.lit("")).alias("name"),  # F6
        "total_messages", "sent_count", "received_count", "last_contact", "avg_size",
    )
    if as_of is not None:
        out = out.withColumn("contact_frequency_score",
                             frequency_score(F.col("total_messages"), F.col("last_contact"), as_of))
    return out


def contact_summary(df: DataFrame, limit: int = 100) -> DataFrame:
    """as F3 with total size, no minimum count, top 100."""
    s = _sender_stats(df)
    return (s.orderBy(F.col("total_messages").desc(), F.col("email").asc()).limit(limit)
             .select("email", "name", "total_messages", "sent_count", "received_count",
                     "last_contact", "total_size", "avg_size"))


def top_senders(df: DataFrame) -> DataFrame:
    """F16: count and whole MB per sender e-mail over all rows (the README
    query has no delete guard); the SQL's integer division is kept."""
    b = df.select(F.col("sender.email").alias("email"), "size")
    g = b.groupBy("email").agg(F.count(F.lit(1)).alias("message_count"),
                               F.sum("size").cast("bigint").alias("_s"))
    return g.select("email", "message_count",
                    F.floor(F.floor(F.col("_s") / KB) / KB).cast("bigint").alias("total_mb"))


# --------------------------------------------------------------- F7 - F10
def hour_histogram(df: DataFrame) -> DataFrame:
    return (live(df).select(F.hour("timestamp").cast("bigint").alias("hour"))
            .groupBy("hour").agg(F.count(F.lit(1)).alias("count")))


def peak_hours(df: DataFrame, k: int = 3) -> DataFrame:
    """the k busiest hours (ties by hour)."""
    return hour_histogram(df).orderBy(F.col("count").desc(), F.col("hour").asc()).limit(k)


def peak_days(df: DataFrame, k: int = 3) -> DataFrame:
    """F8: the k busiest weekdays; ``day_of_week`` 0 = Sunday."""
    b = live(df).select((F.dayofweek("timestamp") - 1).cast("bigint").alias("day_of_week"),
                        F.date_format("timestamp", "EEEE").alias("day_name"))
    g = b.groupBy("day_of_week", "day_name").agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), F.col("day_of_week").asc()).limit(k)


def monthly_trend(df: DataFrame, as_of, months: int = 24) -> DataFrame:
    """``yyyy-MM`` counts for the last ``months`` months before as_of."""
    since = F.add_months(F.to_date(_lit_ts(as_of)), -months).cast("timestamp_ntz")
    b = live(df).filter(F.col("timestamp") >= since)
    return (b.select(F.date_format("timestamp", "yyyy-MM").alias("month"))
             .groupBy("month").agg(F.count(F.lit(1)).alias("count")).orderBy("month"))


def yearly_trend(df: DataFrame) -> DataFrame:
    """counts per year, ordered."""
    return (live(df).select(F.year("timestamp").cast("bigint").alias("year"))
            .groupBy("year").agg(F.count(F.lit(1)).alias("count")).orderBy("year"))


# -------------------------------------------------------------------- F11
def label_distribution(df: DataFrame, k: int = 20) -> DataFrame:
    """label frequencies, top k. ``explode`` is a narrow operator; the
    partial aggregate collapses labels per task before the shuffle."""
    b = live(df).filter(F.col("labels").isNotNull()).select(F.explode("labels").alias("label"))
    g = b.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), F.col("label").asc()).limit(k)


# -------------------------------------------------------------------- F12
SIZE_CLASSES = {"very_small": "size < 1024", "small": "size BETWEEN 1024 AND 10240", "medium": "size BETWEEN 10240 AND 102400",
                "large": "size BETWEEN 102400 AND 1048576", "very_large": "size > 1048576"}


def size_analysis(df: DataFrame) -> DataFrame:
    """size summary and five conditional buckets. The buckets overlap
    at 10240 and 102400 exactly as the BETWEEN ranges do."""
    s = F.col("size")
    a = live(df).select("size").agg(
        F.avg(s).alias("avg_size"), F.min(s).alias("min_size"), F.max(s).alias("max_size"),
        *[F.count_if(F.expr(c)).alias(n) for n, c in SIZE_CLASSES.items()])
    return a.select(
        F.round(F.coalesce("avg_size", F.lit(0.0)) / KB, 2).alias("avg_size_kb"),
        F.coalesce("min_size", F.lit(0)).cast("bigint").alias("min_size_bytes"),
        F.round(F.coalesce("max_size", F.lit(0)) / MB, 2).alias("max_size_mb"),
        "avg_size", "very_small", "small", "medium", "large", "very_large")


# ---------------------------------------------------------- F13, F14, F26
def thread_stats(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """one row per thread: messages, distinct sender e-mails, span."""
    b = live(df, include_deleted).select("thread_id", F.col("sender.email").alias("email"), "timestamp")
    return b.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_distinct("email").alias("participant_count"),
        F.min("timestamp").alias("thread_start"),
        F.max("timestamp").alias("thread_end"),
    )


def thread_analysis(df: DataFrame) -> DataFrame:
    """two-level thread summary."""
    t = thread_stats(df)
    return t.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.avg("message_count").alias("avg_messages_per_thread"),
        F.coalesce(F.max("message_count"), F.lit(0)).cast("bigint").alias("max_messages_in_thread"),
        F.avg("participant_count").alias("avg_participants_per_thread"),
        F.count_if(F.col("message_count") == 1).alias("single_message_threads"),
        F.count_if(F.col("message_count") > 10).alias("long_threads_10plus"),
    )


def complex_threads(df: DataFrame, min_messages: int = 5) -> DataFrame:
    """threads with more than ``min_messages`` messages (all rows, as
    the README query has no delete guard)."""
    t = thread_stats(df, include_deleted=True)
    return (t.filter(F.col("message_count") > min_messages)
             .select("thread_id", "message_count", F.col("participant_count").alias("participants"),
                     "thread_start", "thread_end"))


def hourly_size(df: DataFrame) -> DataFrame:
    """per hour of day: average size and count (all rows)."""
    b = df.select(F.hour("timestamp").cast("bigint").alias("hour"), "size")
    return (b.groupBy("hour").agg(F.avg("size").alias("avg_size"), F.count(F.lit(1)).alias("count"))
             .orderBy("hour"))


# -------------------------------------------------------------------- F23
def indexed_range(df: DataFrame) -> DataFrame:
    """newest and oldest message time (null when empty)."""
    return df.agg(F.max("timestamp").alias("newest"), F.min("timestamp").alias("oldest"))


# -------------------------------------------------------- F19 - F22, A17
METRIC_NAMES = ["total_messages", "total_sent", "total_received", "total_unread",
                "total_size_mb", "avg_message_size_kb"]


def _period_metrics(df: DataFrame, period: Column) -> DataFrame:
    b = live(df).select(period.alias("date"), "is_outgoing", "is_read", "size")
    g = b.groupBy("date").agg(
        F.count(F.lit(1)).cast("double").alias("total_messages"),
        F.count_if(F.col("is_outgoing")).cast("double").alias("total_sent"),
        F.count_if(~F.col("is_outgoing")).cast("double").alias("total_received"),
        F.count_if(~F.col("is_read")).cast("double").alias("total_unread"),
        F.round(F.sum("size") / MB, 2).alias("total_size_mb"),
        F.round(F.avg("size") / KB, 2).alias("avg_message_size_kb"),
    )
    return g.unpivot("date", METRIC_NAMES, "metric_name", "metric_value")


def daily_metrics(df: DataFrame) -> DataFrame:
    """the six daily metrics for every day at once, long form."""
    return _period_metrics(df, F.to_date("timestamp"))


def weekly_metrics(df: DataFrame) -> DataFrame:
    """same metrics per ISO week (Monday start)."""
    return _period_metrics(df, F.to_date(F.date_trunc("week", F.col("timestamp").cast("timestamp"))))


def monthly_metrics(df: DataFrame) -> DataFrame:
    """same metrics per calendar month."""
    return _period_metrics(df, F.trunc(F.col("timestamp").cast("date"), "month"))


def metric_history(metrics: DataFrame, metric_name: str, days: int, as_of) -> DataFrame:
    """one metric, last ``days`` days before as_of, by date."""
    since = F.date_sub(F.to_date(_lit_ts(as_of)), days)
    return (metrics.filter((F.col("metric_name") == metric_name) & (F.col("date") >= since))
            .select("date", "metric_value").orderBy("date"))


def metric_retention(metrics: DataFrame, as_of, retention_days: int = 90) -> DataFrame:
    """drop metric rows older than the retention window."""
    return metrics.filter(F.col("date") >= F.date_sub(F.to_date(_lit_ts(as_of)), retention_days))


def metrics_upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(date, metric_name)`` is unique; the fresh value wins.
    ``unionByName`` + ``row_number`` latest-wins (one shuffle on the key)."""
    both = (stored.select("date", "metric_name", "metric_value", F.lit(0).alias("_v"))
            .unionByName(fresh.select("date", "metric_name", "metric_value", F.lit(1).alias("_v"))))
    w = Window.partitionBy("date", "metric_name").orderBy(F.col("_v").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_v")


METRICS = "metric_name string, metric_value double, date date"


def read_metrics(spark, path: str) -> DataFrame:
    """The stored metric history: date, metric_name, metric_value."""
    return spark.read.schema(METRICS).parquet(path).select("date", "metric_name", "metric_value")


def store_metrics(fresh: DataFrame, path: str) -> None:
    """Write metric rows into the history at ``path``, one folder a date. Of a
    stored day the rows with a fresh value are replaced and the others stay; days
    without fresh rows keep their files. Repeating a write changes nothing."""
    spark = fresh.sparkSession
    fresh, _ = landed(fresh.select("date", "metric_name", "metric_value"), "metrics", "fresh")
    rows = fresh
    if folders(spark, path):
        days = F.broadcast(fresh.select("date").distinct())     # a row per day
        rows = metrics_upsert(read_metrics(spark, path).join(days, "date", "left_semi"), fresh)
    rows, _ = landed(rows, "metrics", "days")
    (rows.repartition("date").sortWithinPartitions("date", "metric_name").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


# ------------------------------------------------------------- G1 / G2
def replies(df: DataFrame) -> DataFrame:
    """The reply pairs: within a thread ordered by (timestamp, message_id),
    an outgoing message right after an incoming one answers it.

    Rows are dealt by ranges of (thread, time, id) and landed with the number of their
    range; neighbours are found inside a range, and the last row of each range, one row
    a range, is handed on to the next. So a thread of any size, even on one day, spreads
    over as many tasks as it fills.
    """
    order = ["thread_id", "timestamp", "message_id"]
    b = live(df).select(*order, "is_outgoing", F.col("sender.email").alias("email"))
    rows, _ = landed(b.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "replies")
    me = F.struct(*order, "is_outgoing", "email")
    inside = rows.withColumn("prev", F.lag(me).over(Window.partitionBy("_range").orderBy(*order)))
    last = rows.groupBy("_range").agg(F.max(me).alias("last"))
    carry = last.select("_range", F.lag("last").over(Window.orderBy("_range")).alias("carry"))
    p = inside.join(F.broadcast(carry), "_range").withColumn("prev", F.coalesce("prev", "carry"))
    r = p.filter(F.col("is_outgoing") & (F.col("prev.thread_id") == F.col("thread_id")) & (~F.col("prev.is_outgoing")))
    micros = (F.unix_micros(F.col("timestamp").cast("timestamp"))
              - F.unix_micros(F.col("prev.timestamp").cast("timestamp")))
    return r.select("thread_id", F.col("prev.message_id").alias("incoming_id"), F.col("message_id").alias("reply_id"),
                    F.col("prev.email").alias("email"), (micros / F.lit(3600e6)).alias("response_hours"),
                    micros.alias("response_micros"))


#: Accuracy of the sketch that brackets a median (it is off by 1 / ACCURACY of the rows at most), and
#: the rows that the bracket may hold before it is narrowed again.
ACCURACY, BRACKET_ROWS = 10_000, 1_000_000


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row ``lo``, ``hi`` (the middle values) of a bigint column. A quantile sketch
    brackets the middle in one pass; a second pass counts what lies below and each value
    inside. A bracket that would hold too many rows is narrowed by another pass."""
    v = df.select(F.col(value).alias("v")).filter("v is not null")
    spark, low, high, n, below, inside = df.sparkSession, None, None, None, 0, None
    while True:
        rank = 0.5 if n is None else ((n - 1) / 2 - below) / max(1, inside)
        at = [min(1.0, max(0.0, rank + d / ACCURACY)) for d in (-2, 2)]
        own = v if low is None else v.filter(F.col("v").between(low, high))
        few = F.array(*[F.lit(x) for x in at])
        got = own.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", few, ACCURACY).alias("q")).first()
        if got["n"] == 0:
            return spark.createDataFrame([(None, None)], "lo long, hi long")
        if n is None:
            n = got["n"]
        before, (low, high) = (low, high) if low is not None else None, got["q"]
        if got["n"] * 6 // ACCURACY <= BRACKET_ROWS or before == (low, high):   # few rows, or few values
            break
        c = v.agg(F.count_if(F.col("v") < low).alias("below"), F.count_if(F.col("v").between(low, high)).alias("inside")).first()
        below, inside = c["below"], c["inside"]
    lo, hi = F.lit((n - 1) // 2), F.lit(n // 2)
    counts = v.filter(F.col("v") <= high).groupBy(F.when(F.col("v") < low, F.lit(None)).otherwise(F.col("v")).alias("v")).count()
    upto = counts.withColumn("upto", F.sum("count").over(Window.orderBy(F.col("v").asc_nulls_first())))   # one row per value inside
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("count") <= rank)
    return upto.agg(F.min(F.when(holds(lo), F.col("v"))).alias("lo"), F.min(F.when(holds(hi), F.col("v"))).alias("hi"))


def contact_response(df: DataFrame) -> DataFrame:
    """G1: average reply delay in hours per e-mail of the incoming sender."""
    r = replies(df).filter(F.col("email").isNotNull() & (F.col("email") != ""))
    # averaged in exact integer microseconds, so the result does not
    # depend on the order partial sums are combined in
    return r.groupBy("email").agg((F.avg("response_micros") / F.lit(3600e6)).alias("avg_response_hours"),
                                  F.count(F.lit(1)).alias("replies"))


def response_stats(df: DataFrame, incoming: Column | None = None) -> DataFrame:
    """Average and median reply delay; rate = replied incoming / incoming
    (counted here, if ``incoming`` isn't given)."""
    pairs = replies(df).select("response_micros")
    r = pairs.agg((F.avg("response_micros") / F.lit(3600e6)).alias("avg_response_hours"), F.count(F.lit(1)).alias("replied"))
    mid = exact_median(pairs, "response_micros")
    hours = lambda c: F.col(c) / F.lit(3600e6)
    if incoming is None:
        incoming = live(df).agg(F.count_if(~F.col("is_outgoing")).alias("incoming")).select("incoming").scalar()
    return r.select(
        F.coalesce("avg_response_hours", F.lit(0.0)).alias("avg_response_hours"),
        F.coalesce(mid.select((hours("lo") + hours("hi")) / 2).scalar(), F.lit(0.0)).alias("median_response_hours"),
        "replied",
        (F.col("replied") * 100.0 / F.nullif(incoming, F.lit(0))).alias(
            "response_rate_percentage"),
    )
