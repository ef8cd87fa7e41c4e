"""Typed schema of the ``messages`` table and its evolution step.

Times are UTC wall-clock ``TIMESTAMP_NTZ`` values, the same reading a
SQL engine gives a naive timestamp column, so oracles agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ADDRESS = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("name", T.StringType()),
])

SENDER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
])

MESSAGES = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("thread_id", T.StringType(), False),
    T.StructField("sender", SENDER),
    T.StructField("recipients", T.MapType(T.StringType(), T.ArrayType(ADDRESS))),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("size", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("is_read", T.BooleanType(), False),
    T.StructField("is_outgoing", T.BooleanType(), False),
    T.StructField("is_deleted", T.BooleanType(), False),
    T.StructField("last_indexed", T.TimestampNTZType(), False),
    T.StructField("custom_data", T.MapType(T.StringType(), T.StringType())),
])

MESSAGE_COLUMNS = [f.name for f in MESSAGES.fields]

# The schema version the migration step brings a table to,
# and the column it adds with its default.
CURRENT_SCHEMA_VERSION = 1
EVOLUTION_STEPS = {1: ("is_deleted", False)}


def conform(df: DataFrame) -> DataFrame:
    """Project ``df`` onto the ``messages`` column order and types."""
    cols = []
    for f in MESSAGES.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def evolve_schema(df: DataFrame, from_version: int = 0) -> DataFrame:
    """Add every column a later schema version introduced, with its
    default, and back-fill nulls. Idempotent: a current table passes
    through unchanged (apart from the null back-fill)."""
    for version in sorted(EVOLUTION_STEPS):
        if version <= from_version:
            continue
        name, value = EVOLUTION_STEPS[version]
        default = F.lit(value)
        if name not in df.columns:
            df = df.withColumn(name, default)
        else:
            df = df.withColumn(name, F.coalesce(F.col(name), default))
    return df


def read_version(spark, path: str) -> int:
    """The version recorded beside a table; 0 when nothing was recorded."""
    from .session import folders
    names = [n for n in folders(spark, f"{path}/_schema_version") if n.startswith("version=")]
    return max((int(n[8:]) for n in names), default=0)


def write_version(spark, path: str, version: int) -> None:
    """Record a version: one row in a folder of its own, so a repeated write or a
    reader in between sees either the old version or the new one."""
    row = spark.range(1).select(F.lit(int(version)).cast("bigint").alias("value"))
    row.write.mode("overwrite").parquet(f"{path}/_schema_version/version={int(version)}")


def sender_email() -> Column:
    return F.col("sender.email")


def sender_name() -> Column:
    return F.col("sender.name")
