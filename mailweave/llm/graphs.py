"""Approximate nearest neighbours by hierarchical navigable small-world graphs.

Distinct vectors are dealt by hash over shards of about ``SHARD_ROWS``. Each shard
is one graph: its vectors in a random order, of which the first n / M^l make up layer
l, and for each layer one flat array of neighbours (a fixed number a vector, -1 where
there is none). A search enters at the first vector, walks greedily through the
upper layers and keeps the ``ef`` best of the lowest one; what the shards find is
merged by Spark. Vectors that one shard takes at a time, and queries that it answers
at a time, go through the layers in step, as numpy arrays (``beam``).

Largest inner product is made a nearest-neighbour search by a further coordinate that
gives all vectors of a shard the same norm; graphs are built on that, and queries have 0
there. Reported scores are inner products of the original vectors in doubles.

Equal vectors are one point of a graph and only its k + 1 smallest ids are kept with
it: of equal scores the smaller ids win, so no other copy can be among k results. Every
vector is indexed; queries go to every shard. A shard's rows and its part of the
answers are bounded; the queries stream past the graph, a bounded number at a time.

Defined cases: rows without vec_id take no part, nor vectors that are null, empty, zero
or hold a null, infinite or NaN component; of several rows with one vec_id the vector
first in array order counts, so repeated rows count once; vectors meet those of equal
length only; fewer than k candidates are all returned as far as the search reaches them
(a shard of at most ``ef`` points is reached whole); ties go to the smaller vec_id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.session import dealt as spread

from .common import staged
from .vec import mix

#: Points of a shard; neighbours of a point in upper layers (twice as many in the lowest).
SHARD_ROWS, M = 10_000, 16
#: Best points kept while building and while searching.
EF_BUILD, EF_SEARCH = 100, 200
#: Searches in step, places of their visited table, points taken up at once, candidates weighed for a point's neighbours.
LANES, VISITED, TAKEN, WEIGHED = 1024, 1 << 26, 1024, 64


# ------------------------------------------------------------------ the graph of one shard
def layer_sizes(n: int, m: int) -> list[int]:
    """Points of each layer, the lowest first."""
    out = [n]
    while out[-1] > m:
        out.append(-(-out[-1] // m))
    return out


def beam(x: np.ndarray, q: np.ndarray, entry: np.ndarray, around: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(points, likeness) of the ``ef`` best that each row of ``q`` finds in one layer
    from its entry points, best first; -1 where there are fewer. ``width`` unvisited
    points of every search are followed at once."""
    n = len(around)
    ids, like = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
    fresh, seen = np.zeros((len(q), ef), bool), np.zeros((len(q), n), bool)
    entry = entry[:, :ef]
    there = entry >= 0
    s = np.where(there, np.einsum("bd,bed->be", q, x[entry]), -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")
    e = entry.shape[1]
    ids[:, :e], like[:, :e] = np.take_along_axis(entry, order, 1), np.take_along_axis(s, order, 1)
    fresh[:, :e] = ids[:, :e] >= 0
    lane, _ = np.nonzero(there)
    seen[lane, entry[there]] = True
    live = np.arange(len(q))
    while len(live):
        pick = fresh[live]
        pick &= np.cumsum(pick, axis=1) <= width
        go = pick.any(axis=1)
        live, pick = live[go], pick[go]
        if not len(live):
            break
        fresh[live] &= ~pick
        row, col = np.nonzero(pick)
        near = around[ids[live[row], col]]
        row, node = np.repeat(row, near.shape[1]), near.ravel()
        row, node = row[node >= 0], node[node >= 0].astype(np.int64)
        new = ~seen[live[row], node]
        key = np.unique(row[new] * n + node[new])
        row, node = key // n, key % n
        seen[live[row], node] = True
        s = np.einsum("id,id->i", q[live[row]], x[node])
        better = s > like[live[row], -1]
        row, node, s = row[better], node[better], s[better]
        if not len(row):
            continue
        some, at, count = np.unique(row, return_index=True, return_counts=True)
        place = np.arange(len(row)) - np.repeat(at, count)
        slot = np.repeat(np.arange(len(some)), count)
        more_ids, more_like = np.full((len(some), count.max()), -1, np.int64), np.full((len(some), count.max()), -np.inf, np.float32)
        more_ids[slot, place], more_like[slot, place] = node, s
        to = live[some]
        all_ids = np.concatenate([ids[to], more_ids], 1)
        all_like = np.concatenate([like[to], more_like], 1)
        all_fresh = np.concatenate([fresh[to], more_ids >= 0], 1)
        best = np.argsort(-all_like, axis=1, kind="stable")[:, :ef]
        ids[to], like[to] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_like, best, 1)
        fresh[to] = np.take_along_axis(all_fresh, best, 1)
    return ids, like


def chosen(x: np.ndarray, ids: np.ndarray, like: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` neighbours for each row of candidates: the likest first, those
    that are liker to one already chosen only where room is left."""
    order = np.argsort(-like, axis=1, kind="stable")[:, :WEIGHED + m]
    ids, like = np.take_along_axis(ids, order, 1), np.take_along_axis(like, order, 1)
    there = (ids >= 0) & (like > -np.inf)
    v = x[np.where(there, ids, 0)]
    among = v @ v.transpose(0, 2, 1)
    kept, shaded, count = np.zeros(ids.shape, bool), np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
    for c in range(ids.shape[1]):
        ok = there[:, c] & ~shaded[:, c] & (count < m)
        kept[:, c] = ok
        count += ok
        shaded |= ok[:, None] & (among[:, c] > like)
    rank = np.where(kept, 0, np.where(there, 1, 2))
    first = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(ids, first, 1), -1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def linked(x: np.ndarray, around: np.ndarray, point: np.ndarray, to: np.ndarray) -> None:
    """Enter ``point`` among the neighbours of every point of ``to`` (-1: none)."""
    m = around.shape[1]
    a, b = np.repeat(point, to.shape[1]), to.ravel()
    a, b = a[b >= 0], b[b >= 0]
    s = np.einsum("id,id->i", x[a], x[b])
    order = np.lexsort((a, -s, b))
    a, b, s = a[order], b[order], s[order]
    whom, at, count = np.unique(b, return_index=True, return_counts=True)
    place = np.arange(len(b)) - np.repeat(at, count)
    slot = np.repeat(np.arange(len(whom)), count)
    use = place < m
    for lo in range(0, len(whom), 512):
        p = whom[lo:lo + 512]
        mine = use & (slot >= lo) & (slot < lo + len(p))
        old = around[p].astype(np.int64)
        new = np.full((len(p), m), -1, np.int64)
        new[slot[mine] - lo, place[mine]] = a[mine]
        new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
        ids = np.concatenate([old, new], 1)
        like = np.where(ids >= 0, np.einsum("bd,bed->be", x[p], x[np.where(ids >= 0, ids, 0)]), -np.inf)
        around[p] = chosen(x, ids, like, m)


def built(x: np.ndarray, m: int = M, ef: int = EF_BUILD) -> list[np.ndarray]:
    """Neighbour arrays of every layer, the lowest first, of points of equal norm."""
    sizes = layer_sizes(len(x), m)
    layers = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k, n in enumerate(sizes)]
    at = 0
    while at < len(x):
        level = max(k for k, n in enumerate(sizes) if at < n)
        to = min(sizes[level], at + max(64, min(TAKEN, at, VISITED // len(x) or 1)))
        point, q = np.arange(at, to), x[at:to]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        near = np.argsort(-own, axis=1, kind="stable")[:, :min(2 * m, len(q) - 1)]
        near, near_like = near + at, np.take_along_axis(own, near, 1)
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            if at and k > level:
                entry = beam(x, q, entry, layers[k], 1)[0]
            elif k <= level:
                ids, like = beam(x, q, entry, layers[k], ef) if at else (np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32))
                picked = chosen(x, np.concatenate([ids, near], 1), np.concatenate([like, near_like], 1), m)
                layers[k][at:to, :m] = picked
                linked(x, layers[k], point, picked)
                entry = ids if at else entry
        at = to
    return layers


def raised(v: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the largest one's norm."""
    square = np.einsum("id,id->i", v, v)
    top = square.max(initial=0.0)
    scale = 1.0 / np.sqrt(top) if top > 0 else 1.0
    return np.concatenate([v * scale, np.sqrt(np.maximum(0.0, 1.0 - square * scale * scale))[:, None]], 1).astype(np.float32)


def found(v: np.ndarray, x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, points, scores) of slices of the queries, best first by the exact scores."""
    lanes = max(1, min(LANES, VISITED // len(x)))
    with np.errstate(over="ignore"):
        far = np.sqrt(np.einsum("id,id->i", q, q))
    scaled = np.concatenate([q / np.where(far > 0, far, 1.0)[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)
    for lo in range(0, len(q), lanes):
        part = scaled[lo:lo + lanes]
        entry = np.zeros((len(part), 1), np.int64)
        for around in layers[:0:-1]:
            entry = beam(x, part, entry, around, 1)[0]
        ids = beam(x, part, entry, layers[0], max(ef, k))[0]
        score = np.where(ids >= 0, (q[lo:lo + lanes, None, :] * v[np.where(ids >= 0, ids, 0)]).sum(2), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        yield lo, np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


# ------------------------------------------------------------------ Spark jobs
def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, one row per vec_id."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    return (vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)
            .groupBy("vec_id").agg(F.min("v").alias("v")))


INDEX = ("dim int, shard int, ids array<bigint>, ends array<int>, vectors binary, sizes array<int>, neighbours array<binary>")


def index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, m: int = M, ef: int = EF_BUILD, name: str = "op13") -> DataFrame:
    """INDEX rows, one per shard, of ``usable`` vectors: points' ids (flat, ``ends`` a
    point's last), vectors as doubles, sizes of the layers and their flat neighbour arrays."""
    nearest = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = (vectors.withColumn("_n", nearest).where(F.col("_n") <= k + 1)
              .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    points = staged(points.select(F.size("v").alias("dim"), "v", "ids"), f"{name}_points")
    shards = points.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("_shards"))
    dealt = points.join(shards, "dim").select("dim", F.pmod(F.xxhash64("v"), F.col("_shards")).cast("int").alias("shard"), "v", "ids")

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        ids = table.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        order = np.lexsort((first, mix(first.view(np.uint64))))
        ids, v = ids.take(pa.array(order)), np.ascontiguousarray(v[order])
        layers = built(raised(v), m, ef)
        row = {"dim": dim, "shard": table.column("shard")[0].as_py(), "ids": ids.flatten().to_pylist(),
               "ends": np.cumsum(ids.value_lengths().to_numpy()).tolist(), "vectors": v.tobytes(),
               "sizes": [len(a) for a in layers], "neighbours": [a.tobytes() for a in layers]}
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())),
            ("vectors", pa.binary()), ("sizes", pa.list_(pa.int32())), ("neighbours", pa.list_(pa.binary()))]))
    # By number, as shards are small files but long work: adaptive execution would put them into one task.
    return staged(spread(dealt, "dim", "shard").groupBy("dim", "shard").applyInArrow(run, INDEX), f"{name}_index")


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's (vec_id, v) nearest ``k`` other vectors."""
    shards = graphs.select("dim", "shard")
    asked = queries.select(F.size("v").alias("dim"), F.col("vec_id").alias("query_id"), F.col("v").alias("query")).join(shards, "dim")
    blank = lambda df, names: df.select("dim", "shard", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in names])
    names = [*[(c.split()[0], c.split()[1]) for c in INDEX.split(", ")[2:]], ("query_id", "bigint"), ("query", "array<double>")]
    rows = blank(graphs, names).union(blank(asked, names))
    rows = spread(rows, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("query_id").asc_nulls_first())

    def run(batches):
        graph = None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            asks = batch.column(batch.num_columns - 2).is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (asks[1:] != asks[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(key)), strict=True):
                if not asks[a]:
                    graph = loaded(batch.slice(a, 1).to_pylist()[0])
                else:
                    part = batch.slice(a, b - a)
                    query = part.column(part.num_columns - 1)
                    yield from answers(graph, part.column(part.num_columns - 2).to_numpy(), query.flatten().to_numpy().reshape(b - a, -1), k, ef)
    hits = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def loaded(row: dict) -> tuple:
    """(first id of each point and the end, ids, vectors, raised vectors, layers) of an INDEX row."""
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    layers = [np.frombuffer(b, np.int32).reshape(n, -1) for n, b in zip(row["sizes"], row["neighbours"], strict=True)]
    return np.append(0, row["ends"]).astype(np.int64), np.array(row["ids"], np.int64), v, raised(v), layers


def answers(graph: tuple, query_id: np.ndarray, q: np.ndarray, k: int, ef: int) -> Iterator[pa.RecordBatch]:
    """The k best (query_id, vec_id, score) of one shard for each query, without itself."""
    start, ids, v, x, layers = graph
    for lo, point, score in found(v, x, layers, q, k + 1, ef):
        row, col = np.nonzero(point >= 0)
        p, s = point[row, col], score[row, col]
        size = start[p + 1] - start[p]
        at = np.repeat(start[p], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row, s, vec = np.repeat(row, size), np.repeat(s, size), ids[at]
        other = vec != query_id[lo + row]
        row, s, vec = row[other], s[other], vec[other]
        order = np.lexsort((vec, -s, row))
        row, s, vec = row[order], s[order], vec[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pa.RecordBatch.from_arrays([pa.array(query_id[lo + row[best]]), pa.array(vec[best]), pa.array(s[best])],
                                         names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, m: int = M, ef_build: int = EF_BUILD,
            ef_search: int = EF_SEARCH, name: str = "op13") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every vector that ``is_query``."""
    rows = staged(usable(vectors), f"{name}_usable")
    return search(index(rows, k, shard_rows, m, ef_build, name), rows.where(is_query), k, ef_search)
