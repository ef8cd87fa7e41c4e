"""Substring search over a trigram index.

The index holds, for each field, which messages contain which run of three characters
of its lower-cased text. Messages are taken in blocks, slices of a batch of one field's
texts; a block's runs are made, sorted and put together where its rows lie, by a numpy
kernel, so that building moves no row between tasks. ``grams`` has a row per (gram, field,
block) with ``n`` and ``places``, the numbers of the block's messages that hold it, by
``bucket`` (hash of the gram) and sorted; a frequent gram lies in as many rows as there are
blocks. In bucket -1 lie each block's message ids, in the order of their numbers. ``counts``
(gram, field, n) says how frequent each gram is.

A needle of three characters or more is looked up by its ``PROBES`` least frequent
runs; messages that hold all of those are candidates, and ``contains`` on the field
itself decides, so results are those of a scan. Shorter needles are scanned for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.runs import text_parts, trigrams_of

FIELDS = {"subject": F.col, "body": F.col, "sender_email": lambda _: F.col("sender.email"), "sender_name": lambda _: F.col("sender.name")}
GRAM_BUCKETS = 64   # default of ``buckets``; raise it with the archive, so that a bucket stays a few files
#: Runs of a needle that are looked up, the least frequent ones; its other runs are left to the check of the text.
PROBES = 4
#: Where ``grams`` keeps the blocks' message ids.
IDS = -1


def _column(field: str) -> Column:
    return FIELDS[field](field)


BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("field", pa.string()), ("gram", pa.string()), ("n", pa.int32()),
                          ("places", pa.list_(pa.int16())), ("message_ids", pa.list_(pa.string()))])
#: Messages of a block at most: their numbers are 16-bit integers.
BLOCK_ROWS = 32_000


def _blocks(fields: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of ids and the fields' lower-cased texts to the rows of ``grams``."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                for k, field in enumerate(fields, 1):
                    for part, text in text_parts(batch.slice(a, BLOCK_ROWS), k):
                        grams, ends, places = trigrams_of(text)
                        if not grams:
                            continue
                        size = len(grams)
                        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int16()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(size, block)), pa.repeat(field, size), pa.array(grams, pa.string()),
                             pa.array(np.diff(ends), pa.int32()), lists, pa.nulls(size, BLOCK_SCHEMA.field("message_ids").type)], schema=BLOCK_SCHEMA)
                        ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).cast(pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([field]), *[pa.nulls(1, BLOCK_SCHEMA.field(c).type) for c in ("gram", "n", "places")], ids],
                                                         schema=BLOCK_SCHEMA)
                        block += 1
    return blocks


def bucket_of(gram: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


@dataclass
class Trigrams:
    """A stored index."""
    grams: DataFrame
    counts: DataFrame
    buckets: int


def store_trigrams(messages: DataFrame, path: str, fields=("subject", "body"), buckets: int = GRAM_BUCKETS) -> Trigrams:
    """Build and write the index of some fields."""
    texts = messages.select("message_id", *[F.lower(_column(f)).alias(f) for f in fields])
    rows = texts.mapInArrow(_blocks(tuple(fields)), "block long, field string, gram string, n int, places array<smallint>, message_ids array<string>")
    rows = rows.withColumn("bucket", F.when(F.col("gram").isNull(), F.lit(IDS)).otherwise(bucket_of("gram", buckets)))
    (rows.sortWithinPartitions("bucket", "gram", "field", "block").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/grams"))
    n = _read(messages.sparkSession, path, "grams").filter(F.col("bucket") != IDS).groupBy("bucket", "gram", "field").agg(F.sum("n").alias("n"))
    n.repartitionByRange("gram").sortWithinPartitions("gram", "field").write.mode("errorifexists").parquet(f"{path}/counts")
    return load_trigrams(messages.sparkSession, path, buckets)


SCHEMAS = {"grams": "block long, field string, gram string, n int, places array<smallint>, message_ids array<string>, bucket int", "counts": "bucket int, gram string, field string, n long"}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def load_trigrams(spark: SparkSession, path: str, buckets: int = GRAM_BUCKETS) -> Trigrams:
    return Trigrams(_read(spark, path, "grams"), _read(spark, path, "counts"), buckets)


def candidates(index: Trigrams, needle: str, field: str) -> DataFrame | None:
    """Ids of the messages that hold the needle's least frequent runs in a field, each
    once; None if the needle is too short for the index."""
    low = needle.lower()
    runs = sorted({low[i:i + 3] for i in range(len(low) - 2)})
    if not runs:
        return None
    known = index.counts.filter((F.col("field") == field) & F.col("gram").isin(runs)).select("gram", "bucket", "n").collect()   # a row per run
    rare = sorted(known, key=lambda r: (r["n"], r["gram"]))[:PROBES]
    if len(known) < len(runs):      # a run that no message has
        return index.grams.filter(F.lit(False)).select(F.explode("message_ids").alias("message_id"))
    hit = index.grams.filter(F.col("bucket").isin([r["bucket"] for r in rare]) & F.col("gram").isin([r["gram"] for r in rare]) & (F.col("field") == field))
    ids = index.grams.filter((F.col("bucket") == IDS) & (F.col("field") == field)).select("block", "message_ids")
    held = hit.select("block", "places").join(ids, "block").select(F.explode(F.transform("places", lambda i: F.get("message_ids", i))).alias("message_id"))
    return held.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("message_id")


def containing(messages: DataFrame, index: Trigrams, needle: str, fields=("subject", "body")) -> DataFrame:
    """Messages with the needle in one of the fields (case-folded)."""
    sought = [candidates(index, needle, f) for f in fields]
    near = messages
    if all(s is not None for s in sought):
        ids = sought[0]
        for s in sought[1:]:
            ids = ids.union(s)
        near = messages.join(ids.distinct(), "message_id", "left_semi")
    low, found = needle.lower(), F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(F.lower(_column(f)), F.lit(low)), F.lit(False))
    return near.filter(found)


def suggestions(messages: DataFrame, index: Trigrams, partial: str, n: int = 10) -> DataFrame:
    """Distinct subjects (first n) and sender e-mails (first n // 2) containing the
    text, merged, sorted, first n; only candidates' subjects and senders are read."""
    def side(field: str, limit: int) -> DataFrame:
        rows = containing(messages, index, partial, (field,)).select(_column(field).alias("suggestion"))
        return rows.filter(F.col("suggestion") != "").distinct().orderBy("suggestion").limit(limit)
    return side("subject", n).union(side("sender_email", n // 2)).distinct().orderBy("suggestion").limit(n)
