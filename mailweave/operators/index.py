"""Full-text search as DataFrame jobs.

Texts are dealt by ranges of the message ids' hashes; the postings ``(term, field, message_id,
tf, positions)`` of a slice of them are made in its task: Arrow kernels number, sort and cut the
words, and put a term's postings together in packed rows, so no posting is
shuffled. A stored index is a set of Parquet tables, each partitioned by ``gen``:

* ``postings`` by ``bucket`` (hash of the term), sorted by term, field and block. A
  block is a range of message-id hashes; a term has a power of two of them, sized from its
  share of the slice (when merged, from its document frequency), so that a frequent term is
  spread over many tasks and files and the blocks of different terms nest. A packed row has
  the postings of a block as far as one slice holds them;
* ``terms``: one row per (term, field, block) with its number of postings and a bound of the
  BM25 impacts among them, range-partitioned by term;
* ``docs``: field lengths per message by ``part`` (hash of the id): which ids are known;
* ``marks``: messages whose earlier postings are void or whose deletion flag changed;
* ``stats``: per field number and total length of messages, all and not deleted;
* ``layout``: in which gen each bucket of the merged index lies.

The first build is gen 0. Change set number b (a batch of a stream, say) adds gen
2 b - 1: postings of its messages in one folder (bucket -1), its marks, and by how much
it changes the statistics. Searches read the merged buckets and the later change sets
together. ``merge`` folds change sets up to b into gen 2 b, which holds the touched
buckets only; the others stay where they are. ``stats`` of a change set and
``layout`` of a merge are written last and make it visible; one job writes at a time.

Message ids found are joined back to ``messages``, where filters, sorting and paging apply.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field as dc_field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.runs import gram_hashes, lists, runs_of, text_parts, words_of
from ..functions.text import normalized, tokens
from ..session import exists, folders, landed
from .search import SearchQuery, matched, page
from .store import joined, laid_over

FIELDS = ["subject", "body", "sender_email", "sender_name", "recipients"]
TEXT_FIELDS = ["subject", "body", "sender_email", "sender_name"]
INDEX_BUCKETS = 64   # default of ``buckets``; raise it with the archive, so that a bucket stays a few files
BLOCK_ROWS = 4096    # postings of a block on average, before a term's number of blocks doubles
HASH_BITS = 30       # of a message id's hash, whose leading bits are its block
K1, B = 1.2, 0.75    # BM25 parameters for which blocks store their highest impact
BROADCAST_BYTES = 32 * 1024 * 1024
FULL_ROWS = 64             # postings from which a packed row is not dealt anew when the index is merged
SLICE_BYTES = 16_000_000   # of a field's texts whose postings are packed at once (some 15 bytes of temporaries each)
#: Literal blocks handed to the scan at most; more are joined.
PUSHED_BLOCKS = 1000


def recipients_text(c: Column | None = None) -> Column:
    """Every recipient as ``"email name "`` joined by spaces."""
    c = F.col("recipients") if c is None else c
    flat = F.flatten(F.map_values(c))
    return F.array_join(F.transform(flat, lambda r: F.concat_ws(" ", r["email"], r["name"])), " ")


def labels_text(c: Column | None = None) -> Column:
    """B16."""
    c = F.col("labels") if c is None else c
    return F.array_join(c, " ")


def index_document(messages: DataFrame) -> DataFrame:
    """The 12 index fields with their defaults."""
    return messages.select(
        "message_id",
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("sender.email", F.lit("")).alias("sender_email"),
        F.coalesce("sender.name", F.lit("")).alias("sender_name"),
        F.coalesce(recipients_text(), F.lit("")).alias("recipients"),
        F.coalesce(labels_text(), F.lit("")).alias("labels"),
        "timestamp",
        F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("is_read", F.lit(False)).alias("is_read"),
        F.coalesce("is_outgoing", F.lit(False)).alias("is_outgoing"),
        F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
    )


# ------------------------------------------------------------------ postings of a slice of messages
def _texts(messages: DataFrame, fields, *more: Column) -> DataFrame:
    """message_id, live, ``more`` and the texts of the fields."""
    docs = messages.select(
        "message_id", (~F.coalesce("is_deleted", F.lit(False))).alias("live"), *more, "subject", "body",
        F.col("sender.email").alias("sender_email"), F.col("sender.name").alias("sender_name"), recipients_text().alias("recipients"))
    return docs.drop(*[f for f in FIELDS if f not in fields])


def _normalized(docs: DataFrame, fields) -> DataFrame:
    """Spark normalizes the texts; Arrow kernels cut and number the words of a slice of rows."""
    return docs.select(*[c for c in docs.columns if c not in fields], *[normalized(F.col(f)).alias(f) for f in fields])


def build_index(messages: DataFrame, fields=FIELDS, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """Postings with term frequency and sorted positions."""
    def run(batches):
        for batch in batches:
            for f in fields:
                for part, text in text_parts(batch, batch.schema.get_field_index(f)):
                    runs = runs_of(text)[1]
                    flat = runs.flatten()
                    positions = flat.field("positions")
                    yield pa.RecordBatch.from_arrays(
                        [flat.field("term"), pa.repeat(f, len(flat)), part.column(0).take(pc.list_parent_indices(runs)),
                         pc.list_value_length(positions).cast(pa.int64()), positions], names=["term", "field", "message_id", "tf", "positions"])
    p = _normalized(_texts(messages, fields), fields).mapInArrow(run, "term string, field string, message_id string, tf long, positions array<int>")
    return p.select("*", bucket_of("term", buckets).alias("bucket"))


PACKED = ("term string, field string, block int, bits int, n int, n_live int, top double, avg double, "
          "hits array<struct<message_id:string,tf:int,dl:int,live:boolean,positions:array<int>>>")
_HITS = ["message_id", "tf", "dl", "live", "positions"]


def _packed(messages: DataFrame, fields, block_rows: int, averages: dict | None) -> DataFrame:
    """PACKED rows: the postings of a term in one block, as far as they lie in one slice.

    The texts are dealt by ranges of the ids' hashes, so that a slice has a range of them,
    and its blocks of frequent terms are whole; postings themselves are never shuffled. How
    many blocks a term has follows from its share of the slice. The highest impact
    is for ``avg``, the slice's own mean length if none is given. Rows of the empty term list the
    slice's messages with their lengths."""
    docs = _texts(messages, fields, hash_of("message_id").alias("at"))
    docs = _normalized(docs.repartitionByRange("at").sortWithinPartitions("at"), fields)
    schema = [x.split()[0] for x in PACKED.split(", ")]

    def row(*columns):
        return pa.RecordBatch.from_arrays(list(columns), names=schema)

    def hits(ids, tf, dl, live, positions):
        return pa.StructArray.from_arrays([ids, pa.array(tf, pa.int32()), pa.array(dl, pa.int32()), pa.array(live), positions], names=_HITS)

    def run(batches):
        for batch in batches:
            for f in fields:
                for part, text in text_parts(batch, batch.schema.get_field_index(f), SLICE_BYTES):
                    ids, live, at = part.column(0), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy().astype(np.int64)
                    size, (dl, owner, place, number, vocabulary) = len(part), words_of(text)
                    none = pa.repeat(0, size).cast(pa.int32())
                    every = hits(ids, none, dl, live, lists(np.zeros(size, np.int64), 0, none[:0]))
                    one = lambda x, kind: pa.array([x], kind)
                    yield row(one("", pa.string()), one(f, pa.string()), *[one(0, pa.int32())] * 4, *[one(0.0, pa.float64())] * 2,
                              lists(np.zeros(1, np.int64), size, every))
                    if not len(owner):
                        continue
                    key = number * size + owner
                    order = np.argsort(key, kind="stable")           # positions of a posting ascend
                    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                    tf = np.diff(np.append(starts, len(order)))
                    word, msg = np.divmod(key[order[starts]], size)
                    ranges = len(np.unique(at))
                    share = int(at.max() - at.min()) * ranges / (ranges - 1) / (1 << HASH_BITS) if ranges > 16 else 1.0
                    df = np.bincount(word, minlength=len(vocabulary)) / min(1.0, share)
                    bits = np.clip(np.ceil(np.log2(np.maximum(df, 1) / block_rows)), 0, HASH_BITS).astype(np.int64)[word]
                    block = at[msg] >> (HASH_BITS - bits)
                    first = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                    avg = averages.get(f, 1.0) if averages is not None else dl.sum() / np.count_nonzero(dl)
                    top = np.maximum.reduceat(impact(tf, dl[msg], avg), first)
                    n = np.diff(np.append(first, len(word)))
                    n_live = np.add.reduceat(live[msg].astype(np.int64), first)
                    positions = lists(starts, len(order), pa.array(place[order], pa.int32()))
                    yield row(vocabulary.take(pa.array(word[first])).cast(pa.string()), pa.repeat(f, len(first)), pa.array(block[first], pa.int32()),
                              pa.array(bits[first], pa.int32()), pa.array(n, pa.int32()), pa.array(n_live, pa.int32()), pa.array(top),
                              pa.repeat(float(avg), len(first)), lists(first, len(word), hits(ids.take(pa.array(msg)), tf, dl[msg], live[msg], positions)))
    return docs.mapInArrow(run, PACKED)


def _packed_again(rows: DataFrame) -> DataFrame:
    """(bucket, born) and PACKED rows from sorted rows (bucket, born, term, field, block, bits, avg
    and a posting): those of a block that follow each other are put together."""
    keys = ["bucket", "born", "term", "field", "block", "bits"]
    schema = ["bucket", "born", *[x.split()[0] for x in PACKED.split(", ")]]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            t = {c: batch.column(c) for c in batch.schema.names}
            new = np.ones(len(batch), bool)
            for c in keys:
                change = pc.not_equal(t[c][1:], t[c][:-1]).to_numpy(zero_copy_only=False)
                new[1:] = change if c == keys[0] else new[1:] | change
            first = np.flatnonzero(new)
            at, total = pa.array(first), len(batch)
            tf, dl, live = (t[c].to_numpy(zero_copy_only=False) for c in ("tf", "dl", "live"))
            top = np.maximum.reduceat(impact(tf, dl, t["avg"].to_numpy()), first)
            hits = pa.StructArray.from_arrays([t["message_id"], t["tf"].cast(pa.int32()), t["dl"], t["live"], t["positions"]], names=_HITS)
            own = {c: t[c].take(at) for c in [*keys, "avg"]} | {
                "n": pa.array(np.diff(np.append(first, total)), pa.int32()), "n_live": pa.array(np.add.reduceat(live.astype(np.int64), first), pa.int32()),
                "top": pa.array(top), "hits": lists(first, total, hits)}
            yield pa.RecordBatch.from_arrays([own[c] for c in schema], names=schema)
    return rows.mapInArrow(run, f"bucket int, born int, {PACKED}")


def unpacked(rows: DataFrame) -> DataFrame:
    """A row per posting of packed rows (without the statistics of these)."""
    rest = [c for c in rows.columns if c not in ("hits", "bits", "n", "n_live", "top", "avg")]
    return rows.select(*rest, F.explode_outer("hits").alias("_h")).select(   # no row is empty; of the structs only what is used is read
        *rest, *[F.col(f"_h.{c}").cast("long").alias(c) if c == "tf" else F.col(f"_h.{c}") for c in _HITS])


def bucket_of(term: Column | str, buckets: int = INDEX_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def hash_of(message_id: Column | str) -> Column:
    return F.pmod(F.xxhash64(message_id), F.lit(1 << HASH_BITS)).cast("int")


def block_of(message_id: Column | str, bits: Column) -> Column:
    """A message's block of a term that has 2 ^ bits of them."""
    return F.call_function("shiftright", hash_of(message_id), F.lit(HASH_BITS) - bits)


# ------------------------------------------------------------------ the stored tables
LENGTHS = -2         # the bucket of the rows that list a slice's messages
TABLES = {
    "postings": f"{PACKED}, born int, gen int, bucket int",
    "terms": "term string, field string, bucket int, block int, bits int, n long, n_live long, top double, avg double, gen int",
    "docs": "message_id string, field string, dl int, live boolean, born int, gen int, part int",
    "marks": "message_id string, b int, gone boolean, live boolean, gen int",
    "stats": "field string, n long, total long, n_live long, total_live long, marks long, gen int",
    "layout": "kind string, bucket int, of int, buckets int, block_rows int, gen int",
}


def impact(tf, dl, avg, k1: float = K1, b: float = B):
    """A posting's BM25 score before the term's weight, of columns or arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))


def _gens(spark: SparkSession, path: str, table: str) -> list[int]:
    names = [int(n[4:]) for n in folders(spark, f"{path}/{table}") if n.startswith("gen=")]
    return sorted(g for g in names if exists(spark, f"{path}/{table}/gen={g}/_SUCCESS"))


@dataclass
class Index:
    """A stored index as of the time it was opened."""
    spark: SparkSession
    path: str
    buckets: int = INDEX_BUCKETS
    block_rows: int = BLOCK_ROWS
    base: int = 0                                     # gen of the latest merge
    deltas: list[int] = dc_field(default_factory=list)   # gens of later change sets
    of: dict = dc_field(default_factory=dict)         # {kind: {gen: its buckets}} of the merged index
    stats: dict = dc_field(default_factory=dict)      # {field: {n, total, n_live, total_live}}
    marked: bool = False
    landed_marks: tuple | None = None                 # marks() and the bytes of their files

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _merged(self, kind: str, key: str) -> Column:
        """Which partitions of postings or docs make up the merged index."""
        own = [(F.col("gen") == g) & (F.col(key).isin(b) if len(self.of[kind]) > 1 else F.lit(True)) for g, b in self.of[kind].items()]
        cond = own[0]
        for c in own[1:]:
            cond = cond | c
        return cond

    def stored(self, name: str) -> DataFrame:
        """Rows of a table that are part of the index, before marks are applied."""
        if name == "postings":
            return unpacked(self.packed().select("*", "_metadata"))
        return self._stored(name)

    def _stored(self, name: str) -> DataFrame:
        key = {"postings": "bucket", "docs": "part"}.get(name)
        cond = self._merged(name, key) if key else F.col("gen") == self.base
        return self.table(name).filter(cond | F.col("gen").isin(self.deltas) if self.deltas else cond)

    def packed(self) -> DataFrame:
        """The index's packed postings, before marks are applied."""
        return self._stored("postings").filter(F.col("bucket") > LENGTHS)

    def marks(self) -> DataFrame:
        """(message_id, gone_b, live_b, live_now): the last void and the last flag of each marked message."""
        m = self.stored("marks")
        return m.groupBy("message_id").agg(F.max(F.when(F.col("gone"), F.col("b"))).alias("gone_b"),
                                           F.max(F.when(F.col("live").isNotNull(), F.struct("b", "live"))).alias("flag")) \
            .select("message_id", "gone_b", F.col("flag.b").alias("live_b"), F.col("flag.live").alias("live_now"))

    def measured_marks(self) -> tuple[DataFrame, int]:
        """``marks`` landed once, so that their size decides how they are joined."""
        if self.landed_marks is None:
            self.landed_marks = landed(self.marks(), "index", "marks")
        return self.landed_marks

    def current(self, rows: DataFrame) -> DataFrame:
        """Rows of postings or docs that still hold, with their present ``live``; rows of
        messages without marks are not shuffled."""
        if not self.marked:
            return rows
        live = F.when(F.col("live_b") > F.col("born"), F.col("live_now")).otherwise(F.col("live"))
        j = laid_over(rows, *self.measured_marks()).filter(F.col("gone_b").isNull() | (F.col("gone_b") <= F.col("born")))
        return j.withColumn("live", live).select(*rows.columns)

    @property
    def postings(self) -> DataFrame:
        return self.current(unpacked(self.packed()))

    @property
    def lengths(self) -> DataFrame:
        """(message_id, field, dl) of every indexed message."""
        return self.current(self.stored("docs")).select("message_id", "field", "dl")

    @property
    def frequencies(self) -> DataFrame:
        """(term, field, bucket, df, df_live) from the stored counts; only postings of marked
        messages are looked at again."""
        t = self.stored("terms").select("term", "field", bucket_of("term", self.buckets).alias("bucket"), "n", "n_live")
        if self.marked:
            p = joined(unpacked(self.packed()), *self.measured_marks())
            holds = F.col("gone_b").isNull() | (F.col("gone_b") <= F.col("born"))
            alive = F.when(F.col("live_b") > F.col("born"), F.col("live_now")).otherwise(F.col("live"))
            t = t.unionByName(p.select("term", "field", bucket_of("term", self.buckets).alias("bucket"),
                                       (holds.cast("long") - 1).alias("n"),
                                       ((holds & alive).cast("long") - F.col("live").cast("long")).alias("n_live")))
        return t.groupBy("term", "field", "bucket").agg(F.sum("n").alias("df"), F.sum("n_live").alias("df_live")).filter("df > 0")


def load_index(spark: SparkSession, path: str) -> Index:
    """Open an index: a few rows of ``layout`` (two per bucket) and ``stats`` (one per field and change set)."""
    base = max(_gens(spark, path, "layout"))
    deltas = [g for g in _gens(spark, path, "stats") if g > base]
    ix = Index(spark, path, base=base, deltas=deltas)
    for r in ix.table("layout").filter(F.col("gen") == base).collect():
        ix.buckets, ix.block_rows = r["buckets"], r["block_rows"]
        ix.of.setdefault(r["kind"], defaultdict(list))[r["of"]].append(r["bucket"])
    s = ix.table("stats").filter(F.col("gen").isin([base, *deltas])).groupBy("field").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "n_live", "total_live", "marks")])
    for r in s.collect():
        ix.stats[r["field"]] = {c: r[c] for c in ("n", "total", "n_live", "total_live")}
        ix.marked = ix.marked or r["marks"] > 0
    return ix


def _counts(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Statistics per field of (field, dl, live) rows."""
    some, live = F.col("dl") > 0, F.col("live")
    return rows.groupBy("field").agg(
        (sign * F.count_if(some)).alias("n"), (sign * F.sum("dl")).cast("long").alias("total"), (sign * F.count_if(some & live)).alias("n_live"),
        (sign * F.sum(F.when(live, F.col("dl")).otherwise(0))).cast("long").alias("total_live"))


def _write_packed(rows: DataFrame, path: str, gen: int) -> DataFrame:
    """Write packed rows with their bucket as ``gen``; returns them as read back."""
    cols = [x.split()[0] for x in TABLES["postings"].split(", ")[:-2]]
    rows = rows.select(*cols, "bucket").sortWithinPartitions("bucket", "term", "field", "block")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/gen={gen}")
    return rows.sparkSession.read.schema(TABLES["postings"].replace(", gen int", "")).parquet(f"{path}/postings/gen={gen}")


def _write_terms(packed: DataFrame, path: str, gen: int, averages: dict, kept: DataFrame | None = None) -> None:
    """The ``terms`` rows of packed postings (with ``kept`` ones) as ``gen``."""
    avg = F.lit(1.0)
    for f, a in averages.items():
        avg = F.when(F.col("field") == f, F.lit(a)).otherwise(avg)
    top = F.col("top") * F.greatest(F.lit(1.0), avg / F.col("avg"))
    t = packed.filter(F.col("bucket") > LENGTHS).groupBy("bucket", "term", "field", "block", "bits").agg(
        F.sum("n").alias("n"), F.sum("n_live").alias("n_live"), F.max(top).alias("top"))
    t = t.withColumn("avg", avg).select(*[c.split()[0] for c in TABLES["terms"].split(", ")[:-1]])
    if kept is not None:
        t = t.unionByName(kept.select(*t.columns))
    t.repartitionByRange("term").sortWithinPartitions("term", "field", "block").write.mode("overwrite").parquet(f"{path}/terms/gen={gen}")


def _averages(stats: dict) -> dict:
    return {f: max(1.0, s["total"] / s["n"]) for f, s in stats.items() if s["n"]}


def _write_change(ix_path: str, messages: DataFrame | None, gen: int, b: int, averages: dict | None, buckets: int, block_rows: int,
                  merged: bool, spark: SparkSession, fields=FIELDS, stats: DataFrame | None = None, marks: DataFrame | None = None) -> None:
    """Tables of one gen made from messages, if any; ``stats`` are further changes of the statistics."""
    p = _packed(messages, fields, block_rows, averages) if messages is not None else spark.createDataFrame([], PACKED)
    bucket = F.when(F.col("term") == "", F.lit(LENGTHS)).otherwise(bucket_of("term", buckets) if merged else F.lit(-1))
    packed = _write_packed(p.withColumn("born", F.lit(b)).withColumn("bucket", bucket), ix_path, gen)      # tokenised once
    part = F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int") if merged else F.lit(-1)
    d = packed.filter(F.col("bucket") == LENGTHS).select("field", "born", F.inline("hits")).select("message_id", "field", "dl", "live", "born")
    d = d.withColumn("part", part)
    (d.repartitionByRange("part", "message_id") if merged else d).sortWithinPartitions("part", "message_id") \
        .write.mode("overwrite").partitionBy("part").parquet(f"{ix_path}/docs/gen={gen}")
    docs = spark.read.schema(TABLES["docs"].replace(", gen int", "")).parquet(f"{ix_path}/docs/gen={gen}")
    counts, _ = landed(_counts(docs), "index", "counts")
    if averages is None:
        averages = _averages({r["field"]: r.asDict() for r in counts.collect()})
    _write_terms(packed, ix_path, gen, averages)
    empty = spark.createDataFrame([], TABLES["marks"].removesuffix(", gen int"))
    (marks if marks is not None else empty).write.mode("overwrite").parquet(f"{ix_path}/marks/gen={gen}")
    n_marks = 0 if marks is None else int(not spark.read.parquet(f"{ix_path}/marks/gen={gen}").isEmpty())
    s = counts if stats is None else counts.unionByName(stats)
    s.withColumn("marks", F.lit(n_marks).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{ix_path}/stats/gen={gen}")


def _write_layout(spark: SparkSession, path: str, gen: int, of: dict, buckets: int, block_rows: int) -> None:
    rows = [(kind, b, g, buckets, block_rows) for kind, gens in of.items() for g, bs in gens.items() for b in bs]
    spark.createDataFrame(rows, TABLES["layout"].removesuffix(", gen int")).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout/gen={gen}")


def store_index(messages: DataFrame, path: str, fields=FIELDS, buckets: int = INDEX_BUCKETS, block_rows: int = BLOCK_ROWS) -> Index:
    """Build and write an index of all messages, deleted ones with their flag."""
    spark = messages.sparkSession
    _write_change(path, messages, 0, 0, None, buckets, block_rows, True, spark, fields)
    every = {0: list(range(buckets))}
    _write_layout(spark, path, 0, {"postings": every, "docs": every}, buckets, block_rows)
    return load_index(spark, path)


# ------------------------------------------------------------------ D2 / K5: changes
def indexed(spark: SparkSession, path: str, b: int) -> bool:
    """Whether change set ``b`` is part of the index."""
    return exists(spark, f"{path}/stats/gen={2 * b - 1}/_SUCCESS") or max(_gens(spark, path, "layout"), default=-1) >= 2 * b


def known(ix: Index, ids: DataFrame) -> DataFrame:
    """``docs`` rows of the ids as they hold now; reads only the parts that their hashes name."""
    part = F.pmod(F.xxhash64("message_id"), F.lit(ix.buckets)).cast("int")
    ids, size = landed(ids.select("message_id").distinct(), "index", "ids")
    at = ids.filter(F.length("message_id") >= 0).select("message_id", F.explode(F.array(part, F.lit(-1))).alias("part"))
    return ix.current(ix.stored("docs").join(F.broadcast(at) if size <= BROADCAST_BYTES else at, ["part", "message_id"], "left_semi"))


def extend(spark: SparkSession, path: str, messages: DataFrame, b: int, fields=FIELDS) -> None:
    """K5: index those of the messages that are not indexed yet, as change set ``b``
    (done already: nothing happens). Text of a stored message never changes, so
    nothing else of a batch has to be indexed, and no stored message is read."""
    if indexed(spark, path, b):
        return
    ix = load_index(spark, path)
    old = known(ix, messages).select("message_id").distinct()
    new = messages.join(old, "message_id", "left_anti")
    _write_change(path, new, 2 * b - 1, b, _averages(ix.stats), ix.buckets, ix.block_rows, False, spark, fields)


def replace(spark: SparkSession, path: str, changed: DataFrame | None, b: int, removed: DataFrame | None = None, fields=FIELDS) -> None:
    """Postings of changed messages are made anew from their current version, those
    of ``removed`` ids become void; stored postings are not rewritten."""
    if indexed(spark, path, b):
        return
    ix = load_index(spark, path)
    ids = [d.select("message_id") for d in (changed, removed) if d is not None]
    old, _ = landed(known(ix, ids[0] if len(ids) == 1 else ids[0].union(ids[1])), "index", "old")
    marks = old.select("message_id").distinct().select("message_id", F.lit(b).alias("b"), F.lit(True).alias("gone"), F.lit(None).cast("boolean").alias("live"))
    _write_change(path, changed, 2 * b - 1, b, _averages(ix.stats), ix.buckets, ix.block_rows, False, spark, fields, _counts(old, -1), marks)


def flag(spark: SparkSession, path: str, ids: DataFrame, live: bool, b: int) -> None:
    """Soft-deleted (``live`` false) or restored messages: a mark and new statistics, no postings."""
    if indexed(spark, path, b):
        return
    ix = load_index(spark, path)
    old, _ = landed(known(ix, ids).filter(F.col("live") != F.lit(live)), "index", "old")
    marks = old.select("message_id").distinct().select("message_id", F.lit(b).alias("b"), F.lit(False).alias("gone"), F.lit(live).alias("live"))
    stats = _counts(old, -1).unionByName(_counts(old.withColumn("live", F.lit(live))))
    _write_change(path, None, 2 * b - 1, b, _averages(ix.stats), ix.buckets, ix.block_rows, False, spark, FIELDS, stats, marks)


def _merged_postings(ix: Index, which: Column, averages: dict) -> DataFrame:
    """Packed rows of the postings that still hold, by bucket, with blocks as frequent as the terms are
    now. Rows of few postings are dealt by ranges of (bucket, term, block), so that they are
    put together; full ones are opened where they lie."""
    order = ["bucket", "term", "field", "born", "at"]
    rows = ix.packed().filter(which).withColumn("bucket", bucket_of("term", ix.buckets))
    df = rows.groupBy("term", "field").agg(F.sum("n").alias("df")).filter(F.col("df") > ix.block_rows)
    hot, size = landed(df.select("term", "field", F.least(F.lit(HASH_BITS), F.ceil(F.log2(F.col("df") / ix.block_rows))).cast("int").alias("more")),
                       "index", "hot")
    at = F.call_function("shiftleft", F.col("block"), F.lit(HASH_BITS) - F.col("bits"))
    rows = rows.join(F.broadcast(hot) if size <= BROADCAST_BYTES else hot, ["term", "field"], "left").withColumn("at", at)
    full, rest = rows.filter(F.col("n") >= FULL_ROWS), rows.filter(F.col("n") < FULL_ROWS)
    p = unpacked(full.sortWithinPartitions(*order).unionByName(rest.repartitionByRange(*order).sortWithinPartitions(*order)))
    if ix.marked:
        p = ix.current(p)
        if ix.measured_marks()[1] > BROADCAST_BYTES:      # rows of marked messages were shuffled
            p = p.sortWithinPartitions(*order, "message_id")
    avg = F.lit(1.0)
    for f, a in averages.items():
        avg = F.when(F.col("field") == f, F.lit(a)).otherwise(avg)
    bits = F.coalesce("more", F.lit(0))
    return _packed_again(p.select("bucket", "born", "term", "field", block_of("message_id", bits).alias("block"), bits.alias("bits"), avg.alias("avg"), *_HITS))


def merge(spark: SparkSession, path: str) -> Index:
    """Fold all change sets into the merged index: buckets that hold one of their terms,
    or a posting that they made void, are written anew; the others keep their files."""
    ix = load_index(spark, path)
    if not ix.deltas:
        return ix
    gen = max(ix.deltas) + 1
    late = F.col("gen").isin(ix.deltas)
    touched = ix.stored("terms").filter(late).select(bucket_of("term", ix.buckets).alias("bucket")).distinct()
    if ix.marked:
        void = ix.table("marks").filter(late & F.col("gone")).select("message_id")
        base = unpacked(ix.packed().filter(~late)).select("bucket", "message_id")
        touched = touched.union(joined(base, *landed(void.distinct(), "index", "void"), "left_semi").select("bucket")).distinct()
    buckets = sorted(r["bucket"] for r in touched.collect())            # at most ``ix.buckets``
    parts = sorted(r["p"] for r in ix.table("docs").filter(late).select(
        F.pmod(F.xxhash64("message_id"), F.lit(ix.buckets)).cast("int").alias("p")).distinct().collect())
    stale = ix.table("terms").filter((F.col("gen") == ix.base) & ~F.col("bucket").isin(buckets))
    averages = _averages(ix.stats)
    _write_terms(_write_packed(_merged_postings(ix, late | F.col("bucket").isin(buckets), averages), path, gen), path, gen, averages, stale)
    d = ix.current(ix.stored("docs").filter(late | F.col("part").isin(parts))).drop("gen")
    (d.withColumn("part", F.pmod(F.xxhash64("message_id"), F.lit(ix.buckets)).cast("int")).repartitionByRange("part", "message_id")
     .sortWithinPartitions("part", "message_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/docs/gen={gen}"))
    ix.stored("marks").drop("gen").write.mode("overwrite").parquet(f"{path}/marks/gen={gen}")
    sums = ix.table("stats").filter(F.col("gen").isin([ix.base, *ix.deltas])).groupBy("field").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "n_live", "total_live", "marks")])
    sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/gen={gen}")
    of = {}
    for kind, new in (("postings", buckets), ("docs", parts)):
        of[kind] = {g: left for g, bs in ix.of[kind].items() if (left := [x for x in bs if x not in set(new)])}
        if new:
            of[kind][gen] = new
    _write_layout(spark, path, gen, of, ix.buckets, ix.block_rows)
    return load_index(spark, path)


# ------------------------------------------------------------------ D3-D5: matching
def _terms(index: Index, terms: DataFrame) -> DataFrame:
    """A query's terms with the buckets they may lie in (a query has a handful of terms).
    The empty term is in no index; filtering it out also tells the optimizer that
    the terms are selective, without which it prunes no partitions."""
    t = terms.select("term").distinct().filter(F.length("term") > 0)
    return t.withColumn("bucket", F.explode(F.array(bucket_of("term", index.buckets), F.lit(-1))))


def _in(rows: DataFrame, fields) -> DataFrame:
    return rows if fields is None else rows.filter(F.col("field").isin(*fields))


def _lookup(index: Index, terms: DataFrame, fields=None, few: bool = True) -> DataFrame:
    """Postings of the query terms (``terms``: a frame with column ``term``; a ``few`` are broadcast)."""
    t = _terms(index, terms)
    return index.current(unpacked(_in(index.packed(), fields).join(F.broadcast(t) if few else t, ["bucket", "term"], "left_semi")))


def match_all(index: Index, terms: DataFrame, fields=None) -> DataFrame:
    """D3 AND: ids holding every query term in some searched field."""
    n = terms.select(F.count_distinct("term")).scalar()
    hits = _lookup(index, terms, fields).groupBy("message_id").agg(F.count_distinct("term").alias("_n"))
    return hits.filter(F.col("_n") == n).select("message_id")


def match_any(index: Index, terms: DataFrame, fields=None) -> DataFrame:
    """D3 OR."""
    return _lookup(index, terms, fields).select("message_id").distinct()


def match_not(index: Index, include: DataFrame, exclude: DataFrame, fields=None) -> DataFrame:
    """D3 NOT: ids with all ``include`` terms and none of ``exclude``."""
    return match_all(index, include, fields).join(match_any(index, exclude, fields), "message_id", "left_anti")


def match_prefix(index: Index, prefix: str, fields=None) -> DataFrame:
    """D4 prefix: a range of the term dictionary, then the postings of what it holds,
    from those terms' buckets only."""
    t = _in(index.stored("terms"), fields).filter(F.col("term").startswith(prefix.lower())).select("term")
    return _lookup(index, t, fields, False).select("message_id").distinct()


def match_phrase(index: Index, phrase: DataFrame, fields=None) -> DataFrame:
    """D4 phrase of any length (``phrase``: rows ``i``, ``term`` with i from 0):
    the i-th term stands at position p + i of one field of a message."""
    words = phrase.select("i", "term").filter(F.length("term") > 0)
    n = words.select(F.count(F.lit(1))).scalar()
    at = _lookup(index, words, fields).join(words, "term").select("message_id", "field", "i", F.explode("positions").alias("pos"))
    runs = at.groupBy("message_id", "field", (F.col("pos") - F.col("i")).alias("p")).agg(F.count(F.lit(1)).alias("_n"))
    return runs.filter(F.col("_n") == n).select("message_id").distinct()


def join_back(messages: DataFrame, ids: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Matched ids → message rows (filters always refer to messages)."""
    m = messages if include_deleted else messages.filter(~F.col("is_deleted"))
    return m.join(ids, "message_id", "left_semi")


def search(messages: DataFrame, index: Index, query: SearchQuery, terms: DataFrame | None = None,
           phrase: DataFrame | None = None, prefix: str | None = None, fields=None) -> tuple[DataFrame, DataFrame]:
    """C26/C28 over the index: messages that hold all ``terms``, the ``phrase`` and a
    term with the ``prefix`` (those given), then the query's filters, sorting and
    paging. Returns (page, all matches)."""
    m = messages
    for ids in ([match_all(index, terms, fields)] if terms is not None else []) + \
            ([match_phrase(index, phrase, fields)] if phrase is not None else []) + \
            ([match_prefix(index, prefix, fields)] if prefix else []):
        m = m.join(ids, "message_id", "left_semi")
    hits = matched(m, query)
    return page(hits, query), hits


# ------------------------------------------------------------------ BM25
class _Ranking:
    """A BM25 query over the stored index: weights from stored statistics, and the
    postings that lie in a set of message blocks."""

    def __init__(self, index: Index, words: list[str], field: str, k1: float, b: float, live_only: bool):
        self.ix, self.words, self.field, self.live_only = index, words, field, live_only
        s = index.stats.get(field, {"n": 0, "total": 0, "n_live": 0, "total_live": 0})
        n, total = (s["n_live"], s["total_live"]) if live_only else (s["n"], s["total"])
        self.avg, self.k1, self.b = (total / n if n else 1.0), k1, b
        self.blocks = index.stored("terms").filter(self._has_word() & (F.col("field") == field))
        df = {w: 0 for w in words}
        for r in index.frequencies.filter(self._has_word() & (F.col("field") == field)).collect() if words else []:   # a row per word
            df[r["term"]] = r["df_live"] if live_only else r["df"]
        self.idf = {w: math.log((n - d + 0.5) / (d + 0.5) + 1.0) for w, d in df.items() if d > 0}

    def _has_word(self) -> Column:
        return F.col("term").isin(self.words)

    def weight(self) -> Column:
        out = F.lit(0.0)
        for w, x in self.idf.items():
            out = F.when(F.col("term") == w, F.lit(x)).otherwise(out)
        return out

    def postings(self, only: list | None = None, joined: DataFrame | None = None) -> DataFrame:
        """Postings of the words, of all blocks or of some: ``only`` (gen, term, block) as
        literals that reach the scan, or ``joined`` rows of them."""
        p = self.ix.packed().filter(self._has_word() & (F.col("field") == self.field))
        near = F.col("bucket").isin([int(x) for x in self._buckets()])
        p = p.filter(near)
        if only is not None:
            by = defaultdict(list)
            for g, t, k in only:
                by[g, t].append(k)
            cond = F.lit(False)
            for (g, t), ks in by.items():
                cond = cond | ((F.col("source") == g) & (F.col("term") == t) & F.col("block").isin(ks))
            p = self._sourced(p).filter(cond).drop("source")
        elif joined is not None:
            p = self._sourced(p).join(joined, ["source", "term", "block"], "left_semi").drop("source")
        p = self.ix.current(unpacked(p))
        return p.filter("live") if self.live_only else p

    def _sourced(self, p: DataFrame) -> DataFrame:
        """``source``: the gen whose ``terms`` rows describe a posting's block."""
        return p.withColumn("source", F.when(F.col("gen") > self.ix.base, F.col("gen")).otherwise(F.lit(self.ix.base)))

    def _buckets(self) -> list[int]:
        row = self.ix.spark.range(1).select(F.array(*[bucket_of(F.lit(w), self.ix.buckets) for w in self.words]).alias("b")).first()
        return sorted({-1, *row["b"]})

    def scores(self, postings: DataFrame) -> DataFrame:
        """Scores rounded to 9 decimals, so ties are stable whatever the summation order."""
        s = self.weight() * impact(F.col("tf"), F.col("dl"), self.avg, self.k1, self.b)
        return postings.groupBy("message_id").agg(F.round(F.sum(s), 9).alias("score"))

    def bounds(self) -> tuple[DataFrame, int]:
        """(at, bound): the highest score possible in each range of message hashes, as
        fine as the finest of the words' blocks; and the bits of those ranges."""
        fine = self.blocks.select(F.max("bits")).first()[0] or 0
        # An average length above the one at which impacts were stored lifts them by at most their ratio.
        top = F.col("top") * F.greatest(F.lit(1.0), F.lit(self.avg) / F.col("avg")) * self.weight()
        width = F.call_function("shiftleft", F.lit(1), F.lit(fine) - F.col("bits"))
        at = F.explode(F.sequence(F.col("block") * width, (F.col("block") + 1) * width - 1))
        per_term = self.blocks.select("term", at.alias("at"), top.alias("top")).groupBy("at", "term").agg(F.max("top").alias("top"))
        return per_term.groupBy("at").agg(F.sum("top").alias("bound")), fine

    def within(self, at: DataFrame, fine: int) -> dict:
        """The words' blocks that cover the ranges, as arguments of ``postings``."""
        b = self.blocks.select(F.col("gen").alias("source"), "term", "block", "bits")
        cover = F.call_function("shiftright", F.col("at"), F.lit(fine) - F.col("bits"))
        bits = b.select("bits").distinct()
        wanted = at.join(F.broadcast(bits)).select("bits", cover.alias("block")).distinct()   # at most HASH_BITS values of bits
        hit = b.join(wanted, ["bits", "block"], "left_semi").select("source", "term", "block")
        some = hit.limit(PUSHED_BLOCKS + 1).collect()
        return {"joined": hit} if len(some) > PUSHED_BLOCKS else {"only": [tuple(r) for r in some]}


def ranked_postings(index: Index, words: list[str], field: str = "body", k: int = 100, k1: float = K1, b: float = B,
                    live_only: bool = True) -> tuple[_Ranking, DataFrame]:
    """The postings that can decide a BM25 top-k. The ranges of messages with the highest
    bounds are scored first; ranges whose bound is below the k-th score found there
    are left out."""
    rank = _Ranking(index, words, field, k1, b, live_only)
    if not words or (k1, b) != (K1, B):
        return rank, rank.postings()
    bounds, fine = rank.bounds()
    if fine == 0:
        return rank, rank.postings()
    bounds, _ = landed(bounds, "index", "bounds")
    first = bounds.orderBy(F.col("bound").desc(), "at").limit(max(8, 2 * k)).select("at")
    best = rank.scores(rank.postings(**rank.within(first, fine))).orderBy(F.col("score").desc()).limit(k)
    least = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
    if least["n"] < k:
        return rank, rank.postings()
    left = bounds.filter(F.col("bound") >= least["s"] - 1e-6).select("at")
    return rank, rank.postings(**rank.within(left, fine))


def bm25(index: Index, terms: DataFrame, field: str = "body", k: int = 100, k1: float = K1, b: float = B, live_only: bool = True) -> DataFrame:
    """Okapi BM25 top-k over one field of a stored index; the query's words (a
    handful) and its constants are stored statistics, postings come from the blocks that
    can hold one of the k best."""
    words = sorted(r["term"] for r in terms.select("term").distinct().collect() if r["term"])
    rank, postings = ranked_postings(index, words, field, k, k1, b, live_only)
    return rank.scores(postings).orderBy(F.col("score").desc(), F.col("message_id").asc()).limit(k)


def top_phrase(messages: DataFrame, n: int, field: str = "body") -> DataFrame:
    """The run of n tokens that most messages hold (ties: the smaller one), as
    (i, term) rows. Hashes of the runs of a slice of messages are counted in its task; only of those
    with the highest count are the runs themselves counted. A collision can only lift
    a hash's count, so if a run reaches the highest one, every run that does is among them."""
    texts = messages.select(normalized(F.col(field)).alias("text"))
    sums, _ = landed(_gram_counts(texts, n).groupBy("h").agg(F.sum("n").alias("n")), "index", "grams")
    most = sums.agg(F.max("n")).first()[0]
    while most:
        top = sums.filter(F.col("n") >= most).limit(PUSHED_BLOCKS + 1).collect()
        if len(top) > PUSHED_BLOCKS:
            break
        counts = _grams(texts, n, np.array([r["h"] for r in top], np.int64)).groupBy("run").agg(F.sum("n").alias("n"))
        best = counts.orderBy(F.col("n").desc(), "run").limit(1).collect()
        if best[0]["n"] >= most:
            return messages.sparkSession.createDataFrame([(best[0]["run"],)], "run array<string>").select(F.posexplode("run").alias("i", "term"))
        most = best[0]["n"]
    t = messages.select(tokens(F.col(field)).alias("t")).filter(F.size("t") >= n)      # very many runs tie
    runs = t.select(F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.slice("t", i, n)))).alias("run"))
    top = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "run").limit(1)
    return top.select(F.posexplode("run").alias("i", "term"))


def _gram_counts(texts: DataFrame, n: int) -> DataFrame:
    """(h, n): in how many messages of a slice a run of n words with that hash is."""
    def run(batches):
        for batch in batches:
            for _, text in text_parts(batch, 0, SLICE_BYTES):
                h, count = np.unique(gram_hashes(text, n)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "n"])
    return texts.mapInArrow(run, "h long, n long")


def _grams(texts: DataFrame, n: int, wanted: np.ndarray) -> DataFrame:
    """(run, n): in how many messages of a slice a run is, of those with a wanted hash."""
    def run(batches):
        for batch in batches:
            for _, text in text_parts(batch, 0, SLICE_BYTES):
                _, first, h, number, vocabulary = gram_hashes(text, n)
                first = first[np.isin(h.view(np.int64), wanted)]
                words, count = np.unique(np.stack([number[first + i] for i in range(n)], 1), axis=0, return_counts=True)
                flat = vocabulary.take(pa.array(words.ravel())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lists(np.arange(len(words)) * n, len(flat), flat), pa.array(count)], names=["run", "n"])
    return texts.mapInArrow(run, "run array<string>, n long")
