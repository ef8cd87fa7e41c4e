"""Helpers shared by the operators: staged tables, global order, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailweave.session import scratch_path

#: The word rule of the contracts, as a Java regex.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    lineage, survives lost executors and gives adaptive execution real sizes."""
    path = scratch_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``rank`` (0-based global position) without a one-task window: rows
    are range-partitioned and staged, each partition numbers its own rows, and
    only one row per partition takes part in the prefix sum of counts."""
    part = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = part.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (part.withColumn("_in", within).join(counts, "_part")
            .withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns a, b): the smallest id
    reachable. Each round points every id at its smallest neighbour, follows
    the pointer twice and contracts the edges, so edges at least halve; hot ids
    cost one partially aggregated row per task."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = staged(edges, f"{name}_edges")
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = staged(ids.select("id", F.col("id").alias("component")), f"{name}_labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hook = staged(hook, f"{name}_hook")
        for _ in range(2):
            up = hook.select(F.col("a").alias("to"), F.col("to").alias("up"))
            hook = hook.join(up, "to").select("a", F.col("up").alias("to"))
        hook = staged(hook, f"{name}_jump")
        to = hook.select(F.col("a").alias("component"), "to")
        labels = staged(labels.join(to, "component", "left")
                        .select("id", F.coalesce("to", "component").alias("component")), f"{name}_labels")
        to_a, to_b = hook.withColumnRenamed("to", "ta"), hook.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = staged(edges.join(to_a, "a").join(to_b, "b")
                       .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                       .where("a < b").distinct(), f"{name}_edges")
    return labels


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup a stream sorted by ``keys`` into tables that hold whole groups;
    only the group at the end of a batch is carried on."""
    import pyarrow.compute as pc
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        cut = 0
        if batch.num_rows > 1:
            change = None
            for k in keys:
                col = batch.column(batch.schema.get_field_index(k))
                ne = pc.not_equal(col.slice(1), col.slice(0, last))
                change = ne if change is None else pc.or_(change, ne)
            at = pc.indices_nonzero(change)
            cut = at[-1].as_py() + 1 if len(at) else 0
        if held:
            same = all(held[-1].column(held[-1].schema.get_field_index(k))[-1]
                       == batch.column(batch.schema.get_field_index(k))[0] for k in keys)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
