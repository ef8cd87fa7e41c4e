"""Extension surface (L1-L10): ordered transform chains, hook points,
message processors, enrichment and redaction, and UDF adapters.

A transform is any ``DataFrame -> DataFrame`` function. Chains apply them
with ``df.transform`` in descending priority (equal priorities keep
insertion order). Spark analyses eagerly, so a transform that does not fit
the frame fails at registration-apply time and is skipped, never at run
time on the executors.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import PHONE_PATTERN, URGENT_PATTERN, redact_cards

log = logging.getLogger(__name__)

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class TransformChain:
    """L1: ordered DataFrame transforms."""
    name: str
    _items: list = field(default_factory=list)
    _seq: int = 0

    def add(self, fn: Transform, priority: int = 10) -> None:
        self._seq += 1
        self._items.append((priority, self._seq, fn))

    def remove(self, fn: Transform) -> bool:
        before = len(self._items)
        self._items = [x for x in self._items if x[2] is not fn]
        return len(self._items) != before

    def ordered(self) -> list[Transform]:
        return [fn for _, _, fn in sorted(self._items, key=lambda x: (-x[0], x[1]))]

    def apply(self, value: Any) -> Any:
        """The value after every transform. A transform that does not fit (on a
        frame: whose plan can't be analysed) is skipped."""
        for fn in self.ordered():
            try:
                out = fn(value)
                if isinstance(out, DataFrame):
                    out.schema  # noqa: B018  (forces analysis now, on the driver)
                value = out
            except (AnalysisException, AttributeError, TypeError, ValueError) as e:
                log.warning("transform %s skipped in chain %s: %s", getattr(fn, "__name__", fn), self.name, e)
        return value


@dataclass
class HookPoint:
    """L3: named callbacks run on the driver around jobs; results listed."""
    name: str
    _items: list = field(default_factory=list)
    _seq: int = 0

    def add(self, fn: Callable, priority: int = 10) -> None:
        self._seq += 1
        self._items.append((priority, self._seq, fn))

    def remove(self, fn: Callable) -> bool:
        before = len(self._items)
        self._items = [x for x in self._items if x[2] is not fn]
        return len(self._items) != before

    def call(self, *args, **kwargs) -> list[Any]:
        out = []
        for _, _, fn in sorted(self._items, key=lambda x: (-x[0], x[1])):
            try:
                out.append(fn(*args, **kwargs))
            except Exception as e:  # noqa: BLE001  a failing callback is skipped
                log.warning("hook %s callback failed: %s", self.name, e)
        return out


# The core filter points and hook points.
FILTER_POINTS = ["message_content", "message_metadata", "search_query", "export_data"]
HOOK_POINTS = ["before_message_sync", "after_message_sync", "before_message_process", "after_message_process",
               "before_database_save", "after_database_save", "sync_complete", "sync_error"]


class Registry:
    """L2/L4: look up, create and remove chains and hooks by name; the
    same name always returns the same object."""

    def __init__(self) -> None:
        self.filters = {n: TransformChain(n) for n in FILTER_POINTS}
        self.hooks = {n: HookPoint(n) for n in HOOK_POINTS}
        self.reports: dict[str, Transform] = {}

    def get_filter(self, name: str) -> TransformChain:
        return self.filters.setdefault(name, TransformChain(name))

    def get_hook(self, name: str) -> HookPoint:
        return self.hooks.setdefault(name, HookPoint(name))

    def apply_filter(self, name: str, value: Any) -> Any:
        """A frame, or what the point is about (``search_query``: the search spec)."""
        return self.get_filter(name).apply(value)

    def call_hook(self, name: str, *args, **kwargs) -> list[Any]:
        return self.get_hook(name).call(*args, **kwargs)

    def register_report(self, name: str, fn: Transform) -> None:
        """An analytics extension is a named DataFrame → DataFrame."""
        self.reports[name] = fn

    def report(self, name: str, df: DataFrame) -> DataFrame:
        return self.reports[name](df)


def apply_processor(df: DataFrame, should_process: Column, updates: dict[str, Column]) -> DataFrame:
    """``when(should_process, new).otherwise(old)`` per updated column."""
    cols = []
    for c in df.columns:
        cols.append(F.when(should_process, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c))
    return df.select(*cols)


def urgency_and_phones(df: DataFrame) -> DataFrame:
    """For unread messages set ``custom_data.priority`` to urgent or
    normal by the subject, and ``phone_numbers`` (comma-joined) when the
    body holds any; other messages are left as they were."""
    phones = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(PHONE_PATTERN), 0)
    urgent = F.coalesce(F.col("subject").rlike(URGENT_PATTERN), F.lit(False))
    entries = F.array(
        F.struct(F.lit("priority").alias("key"),
                 F.when(urgent, F.lit("urgent")).otherwise(F.lit("normal")).alias("value")),
        F.struct(F.lit("phone_numbers").alias("key"),
                 F.when(F.size(phones) > 0, F.array_join(phones, ",")).alias("value")))
    new = F.map_concat(F.coalesce("custom_data", F.create_map().cast("map<string,string>")),
                       F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
    return apply_processor(df, ~F.col("is_read"), {"custom_data": new})


def redact_body(df: DataFrame) -> DataFrame:
    """L9 as a ``message_content`` transform."""
    return df.withColumn("body", redact_cards(F.col("body")))


# ------------------------------------------------------------ L10 adapters
def scalar_udf(fn: Callable, return_type: T.DataType | str):
    """Wrap a pandas ``Series -> Series`` function as an Arrow-batched
    pandas UDF (never a row-at-a-time UDF)."""
    return F.pandas_udf(fn, returnType=return_type)


def batch_transform(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Run a pandas ``DataFrame -> DataFrame`` function over each Arrow
    batch of every partition (``mapInPandas``)."""
    def run(batches):
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def grouped_transform(df: DataFrame, keys: list[str], fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Run a pandas ``DataFrame -> DataFrame`` function on each group of rows; a
    group has to fit one task, so choose keys with small groups."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def expanded(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Run a ``row dict -> iterable of row dicts`` function: none, one or many rows
    out of each, batch by batch."""
    import pandas as pd
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def run(batches):
        for b in batches:
            yield pd.DataFrame([o for r in b.to_dict("records") for o in fn(r)], columns=names)
    return df.mapInPandas(run, schema)
