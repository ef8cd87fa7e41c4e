"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles, hashed to 64 bits. Sets whose
Jaccard similarity reaches t = percent / 100 differ in at most
d = (|A| + |B|) (1 - t) / (1 + t) shingles. Documents are grouped in size bands;
in a band, shingles are dealt over C > d chunks by hash, and each chunk keeps the
parity (XOR) of its shingles: 32 bits of which a shingle flips exactly one, and
32 bits of XORed hashes. The Hamming distance of the one-bit halves is a lower
bound of the symmetric difference. By the pigeonhole principle two sets within d
agree on a whole chunk, so chunks are the join keys; families of documents that
share one are compared by Hamming distance, and what is within the bound is
decided on the shingle sets themselves, which are read once for the nodes in question.

Bands grow by the factor ``GROWTH``; a set too large for no partner in the next
band is in that band as well. Chunks without shingles are no keys: a set with more
than d filled ones shares one of these with each partner (C has a few more than d + 1,
so that most sets do). The other sets meet each other by single shingles besides: of n
shingles at most n (1 - t) are missing in a partner, so the least n (1 - t) + 1 by hash
hold the least common one of both (prefix filter). An empty chunk as a key would put all
sets that lack shingles there into one family, whose pairs grow with the square of its size.

Equal sets are one node (a 64-bit set hash), so copies never form pairs. Before
anything is shuffled back, a fixed-size bitmap of shared keys drops the others.

Defined cases: a null or empty text, or one without words, has no shingles, links
with nothing and is its own component; fewer words than a shingle are one
shingle; rows with one doc_id are told apart by their sets, and each gets the
component of its own set; a component's id is the smallest non-null doc_id in it;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import families, vec
from .common import staged

GROWTH = 1.5


def bands(percent: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, largest difference, chunks) of every band."""
    lo, d, c, at = [], [], [], 1
    while at < most:
        nxt = int(at * GROWTH) + 1
        diff = 2 * (nxt - 1) * (100 - percent) // (100 + percent)
        lo.append(at)
        d.append(diff)
        c.append(diff + 1 + (diff + 5) // 12 + (diff > 2))
        at = nxt
    return np.array(lo), np.array(d), np.array(c)


def sets_of(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a slice of texts."""
    doc, start, end = vec.words(data, off)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    h = vec.span_hash(vec.prefix_hash(data, True), start, end)
    return vec.distinct(*vec.shingles(doc, h, k, len(off) - 1))


def nodes_of(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hash of each document's set."""
    total = np.zeros(len(n), np.uint64)
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        total[doc[first]] = np.add.reduceat(vec.mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
    return vec.mix(total + n.astype(np.uint64)).view(np.int64)


def sketches(doc, h, n, percent: int):
    """For each band that a document is in: (rows, band of the row, word offsets,
    words, (row's number, key) of every key). A word holds the XORed hashes above and the
    parity bits below."""
    lo, diff, chunks = bands(percent, int(n.max(initial=1)) * 2 + 2)
    own = np.searchsorted(lo, n, side="right") - 1
    start = np.append(0, np.cumsum(n))
    up = np.minimum(own + 1, len(lo) - 1)
    both = (own + 1 < len(lo)) & (n * 100 >= percent * lo[up])
    value = (vec.mix(h) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(1) << (h & np.uint64(31)))
    for rows, band in ((np.flatnonzero((n > 0) & (diff[own] > 0)), own), (np.flatnonzero((n > 0) & both & (diff[up] > 0)), up)):
        if not len(rows):
            continue
        c = chunks[band[rows]]
        base = np.append(0, np.cumsum(c))
        m = n[rows]
        token = np.repeat(start[rows] - np.append(0, np.cumsum(m))[:-1], m) + np.arange(m.sum())
        row = np.repeat(np.arange(len(rows)), m)
        at = base[row] + (((h[token] >> np.uint64(32)) * c[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        words = np.zeros(base[-1], np.uint64)
        words[at[first]] = np.bitwise_xor.reduceat(value[token], first)
        filled = np.zeros(base[-1], bool)
        filled[at[first]] = True
        owner = np.repeat(np.arange(len(rows)), c)
        place = np.arange(base[-1]) - base[owner] + (band[rows][owner] << 40) + 1
        key = vec.mix(words ^ vec.mix(place.astype(np.uint64)))[filled]
        few = np.flatnonzero(np.bincount(owner, filled) <= diff[band[rows]])
        p = m[few] * (100 - percent) // 100 + 1
        least = np.repeat(start[rows[few]] - np.append(0, np.cumsum(p))[:-1], p) + np.arange(p.sum())
        place = (np.repeat(band[rows[few]], p) << 40) + (1 << 39)
        key = np.append(key, vec.mix(h[least] ^ vec.mix(place.astype(np.uint64)))) | np.uint64(1 << 63)
        owner = np.append(owner[filled], np.repeat(few, p))
        order = np.argsort(owner, kind="stable")
        yield rows, band[rows], base, words, (owner[order], key[order])


def _sets(batch, k, node_of=None):
    """(batch part, documents, hashes, set sizes, nodes) of each slice; equal sets
    are one node unless ``node_of`` says otherwise."""
    for part, data, off in vec.text_slices(batch):
        doc, h = sets_of(data, off, k)
        n = np.bincount(doc, minlength=len(part)).astype(np.int64)
        yield part, doc, h, n, node_of(data, off, doc, h, n) if node_of else nodes_of(doc, h, n)


def keys_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key) of every chunk of every document."""
    def run(batches):
        for b in batches:
            for _, doc, h, n, _ in _sets(b, k):
                for *_, (_, key) in sketches(doc, h, n, percent):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])
    return docs.select("text").mapInArrow(run, "key long")


ROW = ("doc_id long, tie long, n_shingles long, node long, "
       "sketches array<struct<band:int,payload:binary,keys:array<bigint>>>")


def rows_of(docs: DataFrame, k: int, percent: int, shared: bytes) -> DataFrame:
    """ROW of every document; sketches only for bands in which a key may be shared."""
    told = docs.sparkSession.sparkContext.broadcast(shared)
    kind = pa.list_(pa.struct([("band", pa.int32()), ("payload", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    def run(batches):
        words_seen = np.frombuffer(told.value, np.uint32)
        for b in batches:
            for part, doc, h, n, node in _sets(b, k):
                got: list[list] = [[] for _ in range(len(part))]
                for rows, band, base, words, (owner, key) in sketches(doc, h, n, percent):
                    hit = families.passes(words_seen, key)
                    owner, key = owner[hit], key[hit]
                    cut = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
                    for a, e in zip(cut[:-1], cut[1:], strict=True):
                        i = owner[a]
                        got[rows[i]].append({"band": int(band[i]), "payload": words[base[i]:base[i + 1]].astype(np.uint32).tobytes(),
                                             "keys": key[a:e].view(np.int64)})
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array(node), pa.array(got, kind)],
                    names=["doc_id", "tie", "n_shingles", "node", "sketches"])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, ROW)


def sets_for(docs: DataFrame, k: int, name: str, node_of=None):
    """Function from nodes to (node, items): the whole shingle sets of those nodes, by
    one read of the documents; of equal sets one is kept."""
    def sets(nodes: DataFrame) -> DataFrame:
        told = docs.sparkSession.sparkContext.broadcast(families.bitmap(nodes, "node"))

        def run(batches):
            wanted = np.frombuffer(told.value, np.uint32)
            for b in batches:
                for _, doc, h, n, node in _sets(b, k, node_of):
                    use = families.passes(wanted, node.view(np.uint64)) & (n > 0)
                    use[np.setdiff1d(np.arange(len(n)), np.unique(node, return_index=True)[1])] = False
                    pick = use[doc]
                    at = (np.cumsum(use) - 1)[doc[pick]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[use]), vec.lists(at, h[pick].view(np.int64), int(use.sum()))], names=["node", "items"])
        found = docs.select("text").mapInArrow(run, "node long, items array<bigint>").join(nodes, "node", "left_semi")
        return staged(found.groupBy("node").agg(F.min("items").alias("items")), f"{name}_sets")
    return sets


def alike(percent: int):
    """Whether two ascending arrays of distinct hashes have that Jaccard similarity, with their shared and total number."""
    def same(x: np.ndarray, y: np.ndarray) -> tuple[bool, int, int]:
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        total = len(x) + len(y) - shared
        return shared * 100 >= total * percent, shared, total
    return same


def joined(docs: DataFrame, k: int = 3, percent: int = 90, name: str = "op5") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (doc_id, tie, n_shingles, node, group_id, component_id) of
    every document (``tie``: hash of its text, ``group_id``: null if it has no
    words); links (a, b, shared, total) between nodes, enough of them to
    connect whatever is linked, each verified."""
    shared = keys_of(docs, k, percent).groupBy("key").count().where("count > 1")
    rows = staged(rows_of(docs, k, percent, families.bitmap(shared, "key")), f"{name}_rows")
    own = rows.where(F.size("sketches") > 0).select("node", F.col("n_shingles").alias("size"), F.inline("sketches"))
    sketch = staged(own.select("band", "node", "size", "payload").dropDuplicates(["node", "band"]), f"{name}_sketches")
    members = families.members_of(own.select("band", "node", F.explode("keys").alias("key")), name)

    def close(x, n, xs, ns):
        far = np.bitwise_count(xs ^ x).sum(0, dtype=np.uint32).astype(np.int64)
        total = ns + n
        return (far * (100 + percent) <= total * (100 - percent)) & \
            (np.minimum(ns, n) * 100 >= percent * np.maximum(ns, n))
    found, parts = families.links(members, sketch, close,
                                  sets_for(docs, k, name), alike(percent), name)
    every = rows.select("doc_id", "tie", "n_shingles", "node").join(parts.withColumnRenamed("id", "node"), "node", "left")
    every = every.withColumn("_group", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    first = staged(every.where("_group is not null").groupBy(F.col("_group").alias("_g")).agg(F.min("doc_id").alias("_first")),
                   f"{name}_first")
    every = (every.join(first, F.col("_group") == F.col("_g"), "left")
             .select("doc_id", "tie", "n_shingles", "node", F.col("_group").alias("group_id"),
                     F.coalesce("_first", "doc_id").alias("component_id")))
    return every, found


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, name: str = "op5_stage") -> DataFrame:
    """The document of smallest doc_id of every group of linked documents (null
    ids last, ties by a hash of the text, one of equal rows), all columns
    unchanged; documents without words all stay."""
    rows, _ = joined(docs, k, percent, name)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    rows = staged(rows.where("group_id is not null").select("doc_id", "tie", "group_id", place.alias("place")), f"{name}_groups")
    first = rows.groupBy(F.col("group_id").alias("_g")).agg(F.min("place").alias("_first"))
    told = staged(rows.join(first, F.col("group_id") == F.col("_g")).groupBy("doc_id", "tie")
                  .agg(F.max((F.col("place") == F.col("_first"))).alias("_stays"))
                  .withColumnsRenamed({"doc_id": "_id", "tie": "_t"}), f"{name}_told")
    mine = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"),
                       F.xxhash64("text").alias("_tie"))
    mine = mine.join(told, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")), "left")
    again = F.row_number().over(Window.partitionBy("_doc", "_tie").orderBy("_tie"))
    kept = mine.where("_stays is null or _stays").withColumn("_n", again).where("_stays is null or _n = 1")
    return kept.select("_row.*")
