"""Table maintenance: keyed upsert (A5/E3), delete detection (E2/I1),
soft delete (A6/E5), incremental range (I3).

A batch of changes is landed first and its files are measured: up to
``BROADCAST_BYTES`` it is broadcast, so the stored table is filtered and updated
where it lies and never shuffled. Beyond that a bitmap of the changed ids' hashes
(``BITMAP_BITS``, of fixed size) is broadcast instead: rows that cannot have changed
pass through where they lie, the others are shuffled by id (``overlay``).

A stored table may be laid out by ``bucket``, a hash of the id (``write_table``); then a
batch reads and rewrites the buckets of its ids only (``upsert_table``,
``mark_deleted_table``), each text once and none by a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import MESSAGE_COLUMNS, MESSAGES, conform
from ..session import exchange, landed

#: Parquet bytes up to which a landed batch of ids and flags is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Bits of the bitmap of changed ids (16 MB), in pieces of 4 KB as the built-in bitmap functions make them.
BITMAP_BITS = 1 << 27
TABLE_BUCKETS = 64   # default of ``buckets``; raise it with the archive, so that a bucket stays a few files


def _now(now) -> Column:
    return F.current_timestamp().cast("timestamp_ntz") if now is None else F.lit(now).cast("timestamp_ntz")


def latest_per_id(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per ``message_id``, the latest by ``last_indexed`` (K3); of equal
    times the one whose flags and labels sort last."""
    order = order or [F.col("last_indexed").desc_nulls_last(), F.col("is_read").desc(), F.col("is_deleted"),
                      F.col("labels").desc(), F.xxhash64("subject", "body", "size")]
    w = Window.partitionBy("message_id").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _split(stored: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the ids, rows that have none), by the bitmap of the
    ids' hashes; neither is shuffled."""
    place = F.pmod(F.xxhash64("message_id"), F.lit(BITMAP_BITS))
    bits = (ids.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_piece"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    told = (stored.withColumn("_piece", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_piece", "left")   # at most 16 MB
            .withColumn("_hit", hit).drop("_piece", "_bits"))
    return told.filter("_hit").drop("_hit"), told.filter("not _hit").drop("_hit")


def overlay(stored: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """``stored`` left-joined with ``changes`` (unique message_id); rows that have no
    change are never shuffled, whatever the size of ``changes``."""
    return laid_over(stored, *landed(changes, "batch", name))


def laid_over(stored: DataFrame, changes: DataFrame, size: int) -> DataFrame:
    """``overlay`` of changes that are landed already, in ``size`` bytes."""
    if size <= BROADCAST_BYTES:
        return stored.join(F.broadcast(changes), "message_id", "left")
    may, others = _split(stored, changes)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in changes.schema.fields if f.name != "message_id"]
    return may.join(changes, "message_id", "left").unionByName(others.select("*", *rest))


def matching(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows with one of the ids."""
    return joined(stored, *landed(ids.select("message_id").distinct(), "batch", "ids"), "left_semi")


def joined(stored: DataFrame, ids: DataFrame, size: int, how: str = "inner") -> DataFrame:
    """Stored rows that have one of the landed ids, joined with these."""
    if size <= BROADCAST_BYTES:
        return stored.join(F.broadcast(ids), "message_id", how)
    return _split(stored, ids)[0].join(ids, "message_id", how)


def lacking(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with none of the ids; such rows are not shuffled, whatever the number of ids."""
    return overlay(rows, ids.select("message_id").distinct().withColumn("_known", F.lit(True)), "known").filter("_known IS NULL").drop("_known")


def upsert(existing: DataFrame, incoming: DataFrame, now=None, dedupe: bool = True, dealt_by: Column | None = None) -> DataFrame:
    """A5: insert new ids; for an id already stored update **only**
    ``is_read``, ``labels``, ``last_indexed`` and clear ``is_deleted``;
    subject, body, size, thread and time are never changed. Without ``dedupe`` the
    incoming rows have an id once and are landed already. New rows may be ``dealt_by``
    an expression, so that few files are written for each of its values."""
    ts, inc = _now(now), incoming
    if dedupe:
        inc, _ = landed(latest_per_id(incoming), "batch", "incoming")
    upd = inc.select("message_id", F.col("is_read").alias("_read"), F.col("labels").alias("_labels"),
                     F.lit(True).alias("_hit"))
    kept = overlay(existing, upd, "changes").select(
        *[
            (F.coalesce("_read", "is_read").alias(c) if c == "is_read" else
             F.when(F.col("_hit"), F.col("_labels")).otherwise(F.col("labels")).alias(c) if c == "labels" else
             F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_deleted")).alias(c) if c == "is_deleted" else
             F.when(F.col("_hit"), ts).otherwise(F.col("last_indexed")).alias(c) if c == "last_indexed" else
             F.col(c))
            for c in MESSAGE_COLUMNS
        ])
    known = matching(existing.select("message_id"), inc)
    new = (lacking(inc, known)
              .withColumn("is_deleted", F.lit(False)).withColumn("last_indexed", ts)
              .select(*MESSAGE_COLUMNS))
    return kept.unionByName(new if dealt_by is None else new.repartitionByRange(dealt_by, "message_id"))


def deleted_ids(local: DataFrame, remote_ids: DataFrame) -> DataFrame:
    """Stored ids missing remotely and not already marked deleted.
    Keys are never null, so ``left_anti`` equals set difference."""
    alive = local.filter(~F.col("is_deleted")).select("message_id")
    return alive.join(remote_ids.select("message_id"), "message_id", "left_anti")


def mark_deleted(messages: DataFrame, ids: DataFrame, now=None) -> DataFrame:
    """Set ``is_deleted`` and ``last_indexed`` for the given ids.
    An empty id set leaves the table as it was."""
    j = overlay(messages, ids.select("message_id").distinct().withColumn("_hit", F.lit(True)), "deleted")
    return j.select(*[
        (F.when(F.col("_hit"), F.lit(True)).otherwise(F.col(c)).alias(c) if c == "is_deleted" else
         F.when(F.col("_hit"), _now(now)).otherwise(F.col(c)).alias(c) if c == "last_indexed" else F.col(c))
        for c in MESSAGE_COLUMNS])


def sync_deletions(messages: DataFrame, remote_ids: DataFrame, now=None) -> DataFrame:
    """K7: delete detection (E2) followed by the soft delete."""
    return mark_deleted(messages, deleted_ids(messages, remote_ids), now)


# ------------------------------------------------------------------ a table laid out by id
def bucket(buckets: int = TABLE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int")


def write_table(messages: DataFrame, path: str, buckets: int = TABLE_BUCKETS) -> str:
    """Store messages by bucket of the id, sorted by id inside."""
    _write_buckets(conform(messages).withColumn("bucket", bucket(buckets)).repartitionByRange("bucket", "message_id"), path)
    return path


def _write_buckets(rows: DataFrame, path: str) -> None:
    (rows.sortWithinPartitions("bucket", "message_id").write.mode("errorifexists").option("compression", "zstd")
     .partitionBy("bucket").parquet(path))


def stored_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored messages with their ``bucket``."""
    return spark.read.schema(T.StructType([*MESSAGES.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def _rewrite(spark: SparkSession, path: str, ids: DataFrame, change, buckets: int) -> list[int]:
    """Put ``change(rows)`` in place of the rows of all buckets that hold one of the ids.
    Stored rows lie by bucket already, so they are written without a shuffle, each once,
    into a folder beside the buckets (``_new-...``, which readers pass over); then each
    bucket's folder is exchanged by two renames. What was there is deleted after the last
    one, so a failure on the way loses neither the old rows nor the new."""
    touched = sorted(r["bucket"] for r in ids.select(bucket(buckets).alias("bucket")).distinct().collect())   # at most ``buckets``
    if touched:
        rows = change(stored_table(spark, path).filter(F.col("bucket").isin(touched)).drop("bucket"))
        beside = f"{path}/_new-{uuid.uuid4().hex}"
        _write_buckets(rows.withColumn("bucket", bucket(buckets)), beside)
        exchange(spark, beside, path, [f"bucket={b}" for b in touched])
    return touched


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, now=None, buckets: int = TABLE_BUCKETS) -> list[int]:
    """A5/K8 on a stored table; returns the buckets it rewrote. Repeating a batch changes nothing but ``last_indexed``."""
    inc, _ = landed(latest_per_id(conform(incoming)), "batch", "incoming")
    return _rewrite(spark, path, inc, lambda rows: upsert(rows, inc, now, dedupe=False, dealt_by=bucket(buckets)), buckets)


def mark_deleted_table(spark: SparkSession, path: str, ids: DataFrame, now=None, buckets: int = TABLE_BUCKETS) -> list[int]:
    """A6/E5 on a stored table; ids that are not stored, or marked already, rewrite nothing."""
    near = ids.select("message_id", bucket(buckets).alias("bucket")).distinct()
    alive = stored_table(spark, path).filter(~F.col("is_deleted")).select("message_id", "bucket")
    hit, _ = landed(alive.join(near, ["bucket", "message_id"], "left_semi").select("message_id"), "batch", "deleted")
    return _rewrite(spark, path, hit, lambda rows: mark_deleted(rows, hit, now), buckets)


def incremental_range(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep candidates newer than the stored maximum or older than
    the stored minimum. The bounds are scalar subqueries: computed once,
    no join, no shuffle of the candidates."""
    hi = stored.select(F.max("timestamp")).scalar()
    lo = stored.select(F.min("timestamp")).scalar()
    t = F.col("timestamp")
    return candidates.filter((t > hi) | (t < lo) | hi.isNull())
