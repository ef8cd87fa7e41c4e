"""Summary report (F25) and its sinks.

The report is a table (section, key, metric, value): totals, top-10 contacts,
peaks, trends, label top-20, size and thread summaries, response stats. The few
columns it needs are landed once, and every section is a small aggregate of
them; ``body`` is never read. Times are microseconds since 1970.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import landed
from . import analytics as A

SCHEMA = "section string, key string, metric string, value double"


def _rows(section: str, df: DataFrame, key: str | None = None) -> DataFrame:
    """One row per number of ``df``, under the row's key."""
    named = F.lit("") if key is None else F.col(key).cast("string")
    numbers = []
    for f in df.schema.fields:
        if f.name == key or isinstance(f.dataType, (T.StringType, T.ArrayType, T.StructType)):
            continue
        c = F.col(f.name)
        c = F.unix_micros(c.cast("timestamp")) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else c
        numbers.append(F.struct(F.lit(f.name).alias("metric"), c.cast("double").alias("value")))
    return df.select(F.lit(section).alias("section"), F.coalesce(named, F.lit("")).alias("key"), F.inline(F.array(*numbers)))


def _periods(base: DataFrame, as_of) -> DataFrame:
    """One aggregate over (total, hour, weekday, month, year): ``kind`` and ``key`` with
    the numbers of F1 and F12. Months before the trend's begin have no key."""
    t, s = F.col("timestamp"), F.col("size")
    since = F.add_months(F.to_date(F.lit(as_of).cast("timestamp_ntz")), -24).cast("timestamp_ntz")
    keys = {"hour": F.hour(t).cast("string"), "day": (F.dayofweek(t) - 1).cast("string"),
            "month": F.when(t >= since, F.date_format(t, "yyyy-MM")), "year": F.year(t).cast("string")}
    rows = base.select(*[c.alias(k) for k, c in keys.items()], "timestamp", "size", "is_outgoing", "is_read")
    g = rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("count"), F.count_if("is_outgoing").alias("total_sent"),
        F.count_if(~F.col("is_outgoing")).alias("total_received"), F.count_if(~F.col("is_read")).alias("total_unread"),
        F.coalesce(F.sum(s), F.lit(0)).cast("bigint").alias("total_size_bytes"), F.avg(s).alias("avg_size"),
        F.min(s).alias("min_size"), F.max(s).alias("max_size"), F.min(t).alias("min_date"), F.max(t).alias("max_date"),
        *[F.count_if(F.expr(c)).alias(n) for n, c in A.SIZE_CLASSES.items()])
    kind = F.lit("total")
    for i, k in enumerate(keys):   # the bit of a key that is grouped by is 0
        kind = F.when(F.col("gid") == (15 ^ (8 >> i)), F.lit(k)).otherwise(kind)
    g = g.select(kind.alias("kind"), F.coalesce(*keys).alias("key"), *[c for c in g.columns if c not in (*keys, "gid")])
    return landed(g.filter((F.col("kind") == "total") | F.col("key").isNotNull()).coalesce(1), "report", "periods")[0]   # some hundred rows


def summary_report(messages: DataFrame, as_of, contacts_k: int = 10) -> DataFrame:
    """Five reads of the landed columns: periods and totals, contacts, labels, threads, replies."""
    base, _ = landed(A.live(messages).select("message_id", "thread_id", "sender", "labels", "size", "timestamp", "is_read",
                                             "is_outgoing", "is_deleted"), "report", "columns")
    p = _periods(base, as_of)
    total, of = p.filter("kind = 'total'"), lambda kind: p.filter(F.col("kind") == kind).select("key", "count")
    top = lambda kind: of(kind).orderBy(F.col("count").desc(), F.col("key").cast("int")).limit(3)
    return reduce(DataFrame.unionByName, [
        _rows("basic_metrics", total.select(
            F.col("count").alias("total_messages"), "total_sent", "total_received", "total_unread", "total_size_bytes",
            F.round(F.col("total_size_bytes") / A.MB, 2).alias("total_size_mb"),
            F.round(F.coalesce("avg_size", F.lit(0.0)) / A.KB, 2).alias("avg_message_size_kb"), "min_date", "max_date")),
        _rows("top_contacts", A.contacts(base, contacts_k, as_of).drop("avg_size"), "email"),
        _rows("peak_hours", top("hour"), "key"),
        _rows("peak_days", top("day"), "key"),
        _rows("monthly_trends", of("month"), "key"),
        _rows("yearly_trends", of("year"), "key"),
        _rows("label_distribution", A.label_distribution(base), "label"),
        _rows("size_analysis", total.select(
            F.coalesce("min_size", F.lit(0)).cast("bigint").alias("min_size_bytes"),
            F.round(F.coalesce("max_size", F.lit(0)) / A.MB, 2).alias("max_size_mb"), *A.SIZE_CLASSES)),
        _rows("thread_analysis", A.thread_analysis(base)),
        _rows("response_stats", A.response_stats(base, total.select("total_received").scalar()).drop("response_rate_percentage")),
    ])


def write_report(report: DataFrame, path: str, fmt: str = "json") -> str:
    """The report as JSON lines or as an HTML table, sections in order (a
    report is a few hundred rows, so one file holds it)."""
    rows = report.orderBy("section", "key", "metric").coalesce(1)
    if fmt == "json":
        rows.write.mode("errorifexists").json(path)
    elif fmt == "html":
        cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
        rows.select(F.concat(F.lit("<tr>"), cell(F.col("section")), cell(F.col("key")), cell(F.col("metric")),
                             cell(F.col("value").cast("string")), F.lit("</tr>")).alias("html")) \
            .write.mode("errorifexists").text(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report that was written as JSON."""
    return spark.read.schema(SCHEMA).json(path).fillna("", ["key"])
