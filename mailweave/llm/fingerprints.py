"""Document fingerprints: MinHash over word shingles, vectorised in numpy.

A text's shingles are runs of five words (ASCII letters lower-cased; a text of
fewer words is one shingle). ``PERMS`` universal hash permutations
(a * x + b mod 2^32) are applied to the shingles of a whole slice of documents
at once and reduced to one minimum per document; a fingerprint keeps the low 16
bits of each minimum as hex. The likeness of two fingerprints is the share of
equal positions, an estimate of the Jaccard similarity of the shingle sets.

``neighbours`` gives the next document in descending doc_id without a global
window: rows are cut into ranges of doc_id by quantiles, and each range also
gets the first document of the range below it.

Defined cases: a null text is the empty text; a text without words has the
fingerprint of all ``ffff`` and likeness 1 to its like and 0 to others; rows
with equal doc_id are ordered by a hash of the text, null doc_ids come last; a
single document is its own next one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families, parity, vec
from .common import components, empty, staged

PERMS, SHINGLE, BANDS = 128, 5, 32

_A = (vec.stream(21, PERMS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (vec.stream(22, PERMS) >> np.uint64(32)).astype(np.uint32)
EMPTY = 0xFFFF


def signatures(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """(documents, PERMS) uint16 array of a slice of texts."""
    n = len(off) - 1
    out = np.full((n, PERMS), EMPTY, np.uint16)
    doc, start, end = vec.words(data, off)
    if not len(doc):
        return out
    doc, h = vec.shingles(doc, vec.span_hash(vec.prefix_hash(data, True), start, end), k, n)
    order = np.argsort(doc, kind="stable")
    doc, x = doc[order], (h[order] >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    rows = doc[first]
    buf = np.empty(len(x), np.uint32)
    for j in range(PERMS):
        np.multiply(x, _A[j], out=buf)
        np.add(buf, _B[j], out=buf)
        out[rows, j] = np.minimum.reduceat(buf, first) & np.uint32(0xFFFF)
    return out


def of_texts(texts: list[str]) -> np.ndarray:
    """Signatures of Python strings, a bounded slice at a time."""
    parts = [np.zeros((0, PERMS), np.uint16)]
    raw = [t.encode() for t in texts]
    for a, b in vec.slices(np.array([len(r) for r in raw], np.int64), vec.SLICE_BYTES // 2):
        off = np.zeros(b - a + 1, np.int64)
        np.cumsum([len(r) for r in raw[a:b]], out=off[1:])
        parts.append(signatures(np.frombuffer(b"".join(raw[a:b]), np.uint8), off))
    return np.concatenate(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal positions, row by row."""
    none = (a == EMPTY).all(1) != (b == EMPTY).all(1)
    return np.where(none, 0.0, (a == b).mean(1))


def as_hex(s: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in s.astype(">u2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    def run(batches):
        for b in batches:
            for part, data, off in vec.text_slices(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(as_hex(signatures(data, off)), pa.string())],
                                                 names=["doc_id", "fingerprint"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _range, _ahead) dealt by range and sorted in descending
    doc_id inside each; the last row of a range (``_ahead`` = 1) is the first one
    of the next lower range (for the lowest: of the highest)."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    cuts = sorted(set(at or []))
    # two levels, so that a row is compared with about 2 * sqrt(ranges) cuts
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)] or [[]]
    heads = F.array(*[F.lit(g[0]) for g in groups if g]).cast("array<bigint>")
    whole = F.array(*[F.array(*[F.lit(x) for x in g]).cast("array<bigint>") for g in groups])
    g = F.size(F.filter(heads, lambda c: c < F.col("doc_id")))
    inner = F.size(F.filter(F.element_at(whole, F.greatest(g, F.lit(1))), lambda c: c < F.col("doc_id")))
    where = F.when(F.col("doc_id").isNull(), -1).when(g == 0, 0).otherwise((g - 1) * step + inner)
    docs = docs.withColumn("_range", where.cast("int")).withColumn("_tie", F.xxhash64("text"))
    first = (docs.groupBy("_range").agg(F.max(F.struct("doc_id", F.bitwise_not("_tie").alias("t"))).alias("f")).collect())
    first = sorted((r._range, r.f.doc_id, ~r.f.t) for r in first)
    ahead = [(first[i][0], first[i - 1][1], first[i - 1][2], first[i - 1][0]) for i in range(len(first))]
    ahead = spark.createDataFrame(ahead, "_to int, _id long, _t long, _from int")
    more = (docs.join(F.broadcast(ahead), (F.col("_range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_id"))
                      & (F.col("_tie") == F.col("_t")))
            .select("doc_id", "text", F.col("_to").alias("_range"), "_tie", F.lit(1).alias("_ahead")))
    return (docs.withColumn("_ahead", F.lit(0)).select("doc_id", "text", "_range", "_tie", "_ahead").union(more)
            .repartition(max(1, ranges // 4), "_range")
            .sortWithinPartitions(F.col("_range").desc(), "_ahead", F.col("doc_id").desc(), "_tie")
            .select("doc_id", "text", "_range", "_ahead"))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edit_report(docs: DataFrame) -> DataFrame:
    """SCHEMA rows: each document's fingerprint against those of its edited text
    (the last third replaced by the start of the next document) and of the next
    document."""
    def rows(ids, texts, ahead, nexts, sig, sig_next):
        cut = [len(t) // 3 for t in texts]
        edited = [t[:len(t) - c] + n[:c] for t, c, n in zip(texts, cut, nexts, strict=True)]
        e = of_texts(edited)
        cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(as_hex(sig), pa.string()), pa.array(as_hex(e), pa.string()),
                pa.array(likeness(sig, e)), pa.array(likeness(sig, sig_next))]
        out = pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])
        return out.filter(pa.array([not a for a in ahead], pa.bool_()))

    def run(batches):
        ids, texts, ahead, sig = [], [], [], np.zeros((0, PERMS), np.uint16)
        for b in batches:
            for a, z in vec.slices(np.diff(vec.buffers(b.column(1))[1]), vec.SLICE_BYTES):
                part = b.slice(a, z - a)
                ids += part.column(0).to_pylist()
                more = part.column(1).to_pylist()
                texts += more
                ahead += part.column(3).to_pylist()
                sig = np.concatenate([sig, of_texts(more)])
                if len(ids) > 1:  # the last row waits for the one after it
                    yield rows(ids[:-1], texts[:-1], ahead[:-1], texts[1:], sig[:-1], sig[1:])
                    ids, texts, ahead, sig = ids[-1:], texts[-1:], ahead[-1:], sig[-1:]
    return in_order(docs).mapInArrow(run, SCHEMA)


_COEF = vec.stream(23, PERMS)


def nodes_of(sig: np.ndarray) -> np.ndarray:
    """64-bit id of each signature."""
    return vec.mix((sig.astype(np.uint64) * _COEF).sum(1, dtype=np.uint64)).view(np.int64)


def band_rows(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, node, size, payload, keys): signature and a key for each band; no
    keys for a text without words."""
    width = PERMS // BANDS

    def run(batches):
        for b in batches:
            for part, data, off in vec.text_slices(b):
                sig = signatures(data, off, k)
                some = ~(sig == EMPTY).all(1)
                keys = np.stack([vec.mix((sig[:, i:i + width].astype(np.uint64) * _COEF[i:i + width]).sum(1, dtype=np.uint64)
                                         + np.uint64(i)) for i in range(0, PERMS, width)], 1)
                row = np.repeat(np.flatnonzero(some), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes_of(sig)), pa.array(np.ones(len(part), np.int64)),
                     pa.array([r.tobytes() for r in sig], pa.binary()),
                     vec.lists(row, keys[some].ravel().view(np.int64), len(part))],
                    names=["doc_id", "node", "size", "payload", "keys"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, node long, size long, payload binary, keys array<bigint>")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(links, rows): links (a, b, shared, total) between nodes (distinct
    fingerprints), rows (doc_id, node, component_id) of every document. Bands of
    four positions are the join keys (recall at similarity 0.8 above 0.999999);
    what shares one and looks alike is verified by the exact Jaccard similarity
    of the shingle sets."""
    rows = staged(band_rows(docs, k), "fp_rows")
    one = staged(rows.where(F.size("keys") > 0).withColumn("band", F.lit(0)).dropDuplicates(["node"]), "fp_nodes")
    members = families.members_of(one.select("band", "node", F.explode("keys").alias("key")), "fp")
    least = percent / 100 - 0.2

    def close(x, n, xs, ns):
        return (np.ascontiguousarray(xs.T).view(np.uint16) == np.ascontiguousarray(x.T).view(np.uint16)).mean(1) >= least

    def node_of(data, off, doc, h, n):
        return nodes_of(signatures(data, off, k))
    links, parts = families.links(members, one.select("band", "node", "size", "payload"), close,
                                  parity.sets_for(docs, k, "fp", node_of), parity.alike(percent), "fp")
    every = rows.select("doc_id", "node").join(parts.withColumnRenamed("id", "node"), "node", "left")
    every = every.withColumn("_group", F.coalesce("component", "node"))
    first = staged(every.groupBy(F.col("_group").alias("_g")).agg(F.min("doc_id").alias("_first")), "fp_first")
    return links, (every.join(first, F.col("_group") == F.col("_g"))
                   .select("doc_id", "node", F.coalesce("_first", "doc_id").alias("component_id")))
