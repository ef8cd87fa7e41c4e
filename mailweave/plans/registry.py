"""Registry of named queries.

Each entry is a function ``(spark, sf_dir) -> DataFrame`` plus, when the
result is expressible in plain SQL over the input tables, the oracle SQL
text DuckDB runs on the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"{__package__}.{mod}")


PLAN_MODULES = ["analytics_plans", "search_plans", "store_plans", "parse_plans", "index_plans", "export_plans", "attachment_plans", "enrich_plans", "stream_plans",
                "function_plans"]
