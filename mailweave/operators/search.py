"""Composable search.

A ``SearchQuery`` compiles to a list of ``Column`` predicates on the
``messages`` table, so the whole search is one logical plan: Catalyst
pushes the simple predicates into the Parquet scan and plans ``limit``
after ``orderBy`` as a single ``TakeOrderedAndProject``.
"""

from __future__ import annotations

import functools
import operator as _op
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import landed

OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge", "like", "not_like", "in", "not_in",
             "between", "is_null", "is_not_null")


@dataclass
class SearchFilter:
    field: str
    operator: str
    value: Any = None
    case_sensitive: bool = False


@dataclass
class SearchQuery:
    text: str | None = None
    filters: list[SearchFilter] = field(default_factory=list)
    sort_field: str | None = None
    sort_order: str = "DESC"
    limit: int | None = None
    offset: int = 0
    include_deleted: bool = False
    date_range: tuple | None = None


def build_query(**kw) -> SearchQuery:
    """Spec from keyword arguments (filters given as dicts)."""
    order = str(kw.get("sort_order", "DESC")).upper()
    if order not in ("ASC", "DESC"):
        raise ValueError(f"sort_order must be ASC or DESC, not {order!r}")
    return SearchQuery(
        text=kw.get("text"),
        filters=[f if isinstance(f, SearchFilter) else SearchFilter(**f) for f in kw.get("filters", [])],
        sort_field=kw.get("sort_field"), sort_order=order, limit=kw.get("limit"),
        offset=kw.get("offset", 0) or 0, include_deleted=kw.get("include_deleted", False),
        date_range=kw.get("date_range"))


def _column(df: DataFrame, name: str) -> Column:
    root = name.split(".", 1)[0]
    if root not in df.columns:
        raise ValueError(f"unknown field {name!r}")
    return F.col(name)


def compile_filter(df: DataFrame, f: SearchFilter) -> Column:
    """One filter → one predicate. String values compare lower-cased
    unless ``case_sensitive``; list values are always compared as given."""
    if f.operator not in OPERATORS:
        raise ValueError(f"unknown operator {f.operator!r}")
    c = _column(df, f.field)
    v = f.value
    if not f.case_sensitive and isinstance(v, str):
        c, v = F.lower(c), v.lower()
    op = f.operator
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op in ("in", "not_in"):
        vals = list(v) if isinstance(v, (list, tuple, set)) else [v]
        p = c.isin(vals)
        # SQL semantics: with a null in the list NOT IN is never true
        return p if op == "in" else ~p
    if op == "between":
        if not isinstance(v, (list, tuple)) or len(v) != 2:
            raise ValueError(f"between needs exactly 2 values, got {v!r}")
        return c.between(F.lit(v[0]), F.lit(v[1]))
    if op == "like":
        return c.ilike(v)
    if op == "not_like":
        return ~c.ilike(v)
    fn = {"eq": _op.eq, "ne": _op.ne, "lt": _op.lt, "le": _op.le, "gt": _op.gt, "ge": _op.ge}[op]
    return fn(c, F.lit(v))


def text_predicate(text: str) -> Column:
    """LIKE fallback: subject or body contains ``text`` (case-folded)."""
    t = text.lower()
    return (F.lower("subject").contains(t)) | (F.lower("body").contains(t))


def predicates(df: DataFrame, q: SearchQuery) -> list[Column]:
    preds = []
    if q.text:
        preds.append(text_predicate(q.text))
    preds += [compile_filter(df, f) for f in q.filters or []]
    if q.date_range:
        a, b = q.date_range
        preds.append(F.col("timestamp").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))
    if not q.include_deleted:
        preds.append(~F.col("is_deleted"))
    return preds


def matched(df: DataFrame, q: SearchQuery) -> DataFrame:
    """Every predicate ANDed, no sort or paging (the total's base)."""
    ps = predicates(df, q)
    return df.filter(functools.reduce(_op.and_, ps)) if ps else df


def ordering(df: DataFrame, q: SearchQuery) -> list[Column]:
    """H1/H2: chosen column (validated) or newest first; ties by id."""
    name = q.sort_field or "timestamp"
    return _sorted(_column(df, name), F.col("message_id"), _ascending(q))


def _ascending(q: SearchQuery) -> bool:
    return (q.sort_order or "DESC").upper() == "ASC"


def _sorted(key: Column, ident: Column, ascending: bool) -> list[Column]:
    return [key.asc() if ascending else key.desc(), ident.asc()]


def page(df: DataFrame, q: SearchQuery) -> DataFrame:
    """H3/H4: falsy limit = no limit; offset works without a limit."""
    order = ordering(df, q)
    if q.limit:
        return df.orderBy(*order).offset(int(q.offset or 0)).limit(int(q.limit))
    return skipped(df, q).orderBy(*order) if q.offset else df.orderBy(*order)


def skipped(df: DataFrame, q: SearchQuery) -> DataFrame:
    """All rows but the first ``offset`` in the query's order, without gathering any.
    Only the two sort keys are landed, in ranges of the order; the ranges are counted and
    the one that holds the offset numbers its keys. The key found there cuts the rows
    where they lie: later ones stay, and of rows with that very key the right number."""
    offset, asc = int(q.offset), _ascending(q)
    key, ident = _column(df, q.sort_field or "timestamp"), F.col("message_id")
    order = _sorted(F.col("_key"), F.col("_id"), asc)
    keys = df.select(key.alias("_key"), ident.alias("_id"))
    ranges, _ = landed(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "page")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = ranges.groupBy("_range").count().withColumn("_upto", F.sum("count").over(upto))   # a row per range
    counts = counts.select("_range", (F.col("_upto") - F.col("count")).alias("_before"), "_upto")
    inside = ranges.join(F.broadcast(counts.filter((F.col("_before") <= offset) & (F.col("_upto") > offset))), "_range")
    at = Window.partitionBy("_range").orderBy(*order)
    first = (inside.select("_key", "_id", "_before", F.row_number().over(at).alias("_n"), F.rank().over(at).alias("_rank"))
             .filter(F.col("_n") + F.col("_before") == offset + 1)
             .select("_key", "_id", (F.col("_n") - F.col("_rank")).alias("_equal")))
    first, _ = landed(first, "page")                                                           # one row, or none past the end
    cut = df.join(F.broadcast(first))
    same_key = key.eqNullSafe(F.col("_key"))
    past = (key > F.col("_key")) | (key.isNotNull() & F.col("_key").isNull()) if asc else (key < F.col("_key")) | (key.isNull() & F.col("_key").isNotNull())
    past = F.coalesce(past, F.lit(False)) | (same_key & F.coalesce((ident > F.col("_id")) | (ident.isNotNull() & F.col("_id").isNull()), F.lit(False)))
    equal = same_key & ident.eqNullSafe(F.col("_id"))
    found = first.select("_equal").first()
    if found is None or found["_equal"] == 0:        # no row before the cut has the key of the cut
        return cut.filter(past | equal).select(*df.columns)
    tied = cut.filter(equal).withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_id").orderBy(F.lit(0))))
    return cut.filter(past).select(*df.columns).unionByName(tied.filter(F.col("_n") > F.col("_equal")).select(*df.columns))


def search(df: DataFrame, q: SearchQuery) -> tuple[DataFrame, DataFrame]:
    """(page, matched). ``matched.count()`` is the total before paging."""
    m = matched(df, q)
    return page(m, q), m


def total_count(df: DataFrame, q: SearchQuery) -> DataFrame:
    """the unpaged match count as a one-row frame."""
    return matched(df, q).agg(F.count(F.lit(1)).alias("total_count"))


# ---------------------------------------------------------- convenience
def by_sender(df: DataFrame, needle: str, limit: int = 100) -> DataFrame:
    """C20: substring of the sender e-mail or name (not the JSON keys)."""
    n = needle.lower()
    p = F.lower("sender.email").contains(n) | F.lower("sender.name").contains(n)
    return page(df.filter(p & ~F.col("is_deleted")), SearchQuery(limit=limit))


def by_date_range(df: DataFrame, start, end) -> DataFrame:
    """C17."""
    return search(df, SearchQuery(date_range=(start, end)))[0]


def unread(df: DataFrame, limit: int = 100) -> DataFrame:
    """C21."""
    return search(df, SearchQuery(filters=[SearchFilter("is_read", "eq", False)], limit=limit))[0]


def large(df: DataFrame, min_size_mb: float = 1.0) -> DataFrame:
    """At least ``min_size_mb`` MB, biggest first."""
    b = int(min_size_mb * 1024 * 1024)
    return search(df, SearchQuery(filters=[SearchFilter("size", "ge", b)], sort_field="size"))[0]


def suggestions(df: DataFrame, partial: str, n: int = 10) -> DataFrame:
    """Distinct subjects (first n) and sender e-mails (first n // 2)
    containing the text, merged, sorted, first n. Each side is a distinct
    aggregate followed by a bounded top-k."""
    t = partial.lower()
    subj = (df.select(F.col("subject").alias("suggestion"))
              .filter(F.col("suggestion").isNotNull() & (F.col("suggestion") != "")
                      & F.lower("suggestion").contains(t))
              .distinct().orderBy("suggestion").limit(n))
    mail = (df.select(F.col("sender.email").alias("suggestion"))
              .filter(F.col("suggestion").isNotNull() & (F.col("suggestion") != "")
                      & F.lower("suggestion").contains(t))
              .distinct().orderBy("suggestion").limit(n // 2))
    return subj.union(mail).distinct().orderBy("suggestion").limit(n)


def export_filters(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """The export filter set; live rows, newest first.

    ``has_label`` is a substring test within each label (not across label
    borders); ``is_unread=True`` keeps unread rows, ``False`` read ones.
    """
    preds = [~F.col("is_deleted")]
    for k, v in (filters or {}).items():
        if k == "date_range":
            a, b = v
            preds.append(F.col("timestamp").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))
        elif k == "sender_email":
            preds.append(F.lower("sender.email").contains(str(v).lower()))
        elif k == "subject_contains":
            preds.append(F.lower("subject").contains(str(v).lower()))
        elif k == "has_label":
            x = str(v).lower()
            preds.append(F.exists("labels", lambda lab: F.lower(lab).contains(x)))
        elif k == "is_unread":
            preds.append(F.col("is_read") == F.lit(not v))
        elif k == "min_size_mb":
            preds.append(F.col("size") >= F.lit(int(v * 1024 * 1024)))
        else:
            raise ValueError(f"unknown export filter {k!r}")
    return df.filter(functools.reduce(_op.and_, preds)).orderBy(F.col("timestamp").desc(), "message_id")


def param_sql(spark, messages: DataFrame, query: str, params: list) -> DataFrame:
    """A1: arbitrary SQL with positional ``?`` markers over ``{messages}``.
    The frame is bound by reference (no global view name is taken)."""
    return spark.sql(query, args=list(params), messages=messages)
