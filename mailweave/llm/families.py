"""Links between similar items without pairs of whole groups.

Items (``node``, a 64-bit id of one distinct content) that share a join key form
a family around the key's smallest node, its center. Families meet in cells of bounded
size, at most twice:

* families around neighbouring centers mostly have the same members (a group of near copies
  shares many keys); a family that has half of its members in common with the one its center
  belongs to is laid into that, so that pairs do not meet once a key;
* each family is cut into parts by node, and its center joins every part, so that work
  and shuffle are linear in the family. A numpy test on compact payloads groups what may
  be similar; only of items in such a group do the sets themselves travel, and a pair
  links if its sets say so. Pairs that checked links have joined already are left out;
* members of a cut family that are not joined with its center by then (in a family of
  near copies there are few, or none) meet all its other parts, in cells (part of the
  rest, part of the family); again only what looks similar is decided by sets.

So every link between different contents is found or implied by a chain of checked
links, nothing is capped, and a family of n copies of one thing costs n checks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.session import dealt as spread

from .common import components, empty, staged, whole_groups

#: Rows and bytes (of payloads and sets) of a family's part, at most, and of the parts that meet across: these are
#: larger, as every row travels once for each part of the other side.
CELL_ROWS, CELL_BYTES = 256, 8_000_000
ACROSS_ROWS, ACROSS_BYTES = 8000, 48_000_000
BITMAP_BITS = 1 << 27


def bitmap(df: DataFrame, column: str) -> bytes:
    """Fixed-size (16 MB) bitmap of the column's values, for dropping rows that
    can't join before they are shuffled; false hits only cost time. Words are
    or-ed by an aggregate, so what reaches the driver is bounded too."""
    at = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    got = df.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, "<i8")
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.tobytes()


def passes(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which (unsigned 64-bit) values may be in the bitmap."""
    at = values & np.uint64(BITMAP_BITS - 1)
    return (words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def members_of(keys: DataFrame, name: str) -> DataFrame:
    """(band, center, node) of every node that shares a key, from (band, key,
    node); the center is the smallest node with that key and a member too.
    Both sides of the join back are shuffled anew, so that a hot key is split."""
    shared = staged(keys.groupBy("band", "key").agg(F.min("node").alias("center"), F.max("node").alias("_last"))
                    .where("center < _last").select("key", "center"), f"{name}_shared")
    return staged(keys.join(shared, "key").select("band", "center", "node").distinct(), f"{name}_members")


#: A cell; ``rest``: the row's side where parts meet across, else null.
CELL = ["band", "center", "p", "q"]


def _parts(n: str, b: str, rows: int, most: int) -> Column:
    return F.ceil(F.greatest(F.col(n) / rows, F.col(b) / most)).cast("int")


def laid_together(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (band, center, node, bytes) with families laid into those they resemble. Any
    choice of these is right: a family's members stay together."""
    size = staged(rows.groupBy("band", "center").agg(F.count("*").alias("n")), f"{name}_sizes")
    of_center = rows.join(size.select("band", F.col("center").alias("node")), ["band", "node"]).where("center < node")
    into = staged(of_center.groupBy("band", F.col("node").alias("center")).agg(F.min("center").alias("to")), f"{name}_into")
    there = rows.select("band", F.col("center").alias("to"), "node")
    common = rows.join(into, ["band", "center"]).join(there, ["band", "to", "node"]).groupBy("band", "center", "to").agg(F.count("*").alias("m"))
    hook = staged(common.join(size, ["band", "center"]).where("2 * m >= n").select("band", "center", "to"), f"{name}_hook")
    while True:      # follow chains to their ends (each leads to smaller centers), so that every center kept is a member
        up = hook.select("band", F.col("center").alias("to"), F.col("to").alias("up"))
        if hook.join(up, ["band", "to"], "left_semi").isEmpty():
            break
        hook = staged(hook.join(up, ["band", "to"], "left").select("band", "center", F.coalesce("up", "to").alias("to")), f"{name}_hook")
    moved = rows.join(hook, ["band", "center"], "left").select("band", F.coalesce("to", "center").alias("center"), "node", "bytes")
    return staged(moved.distinct(), f"{name}_together")


def families_of(members: DataFrame, payload: DataFrame, name: str) -> DataFrame:
    """(band, center, node, g): members with the number of parts of their family."""
    sizes = payload.select("band", "node", (F.octet_length("payload") + 8 * F.col("size")).alias("bytes"))
    rows = laid_together(staged(members.join(sizes, ["band", "node"]), f"{name}_sized"), name)
    big = rows.groupBy("band", "center").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).withColumn("g", _parts("n", "b", CELL_ROWS, CELL_BYTES)).where("g > 1")
    big = staged(big.select("band", "center", "g"), f"{name}_big")    # from files, so that the join can split a hot center
    return rows.join(big, ["band", "center"], "left").select("band", "center", "node", "bytes", F.coalesce("g", F.lit(1)).alias("g"))


def own_cells(rows: DataFrame) -> DataFrame:
    """Cells of the families' parts; the center is in each."""
    part = F.when(F.col("node") == F.col("center"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("g")).cast("int")))
    return rows.select("band", "center", F.explode(part).alias("p"), F.lit(0).alias("q"), "node", F.col("node").alias("known"),
                       F.lit(None).cast("boolean").alias("rest"))


def cross_cells(rows: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Cells in which members not joined with their center (``parts``: id, component)
    meet the whole family."""
    known = parts.select(F.col("id").alias("node"), F.col("component").alias("known"))
    rows = rows.where("g > 1").join(known, "node", "left").withColumn("known", F.coalesce("known", "node"))
    hub = rows.where("node = center").select("band", "center", F.col("known").alias("hub"))
    rows = staged(rows.join(hub, ["band", "center"]).withColumn("rest", F.col("known") != F.col("hub")), f"{name}_known")
    load = rows.groupBy("band", "center").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.count_if("rest").alias("nr"),
                                              F.sum(F.when(F.col("rest"), F.col("bytes"))).alias("br"))
    load = staged(load.where("nr > 0").select("band", "center", _parts("n", "b", ACROSS_ROWS, ACROSS_BYTES).alias("gq"),
                                              _parts("nr", "br", ACROSS_ROWS, ACROSS_BYTES).alias("gp")), f"{name}_load")
    rows = rows.drop("g", "hub", "bytes").join(load, ["band", "center"])
    h = F.xxhash64("node")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = rows.where("rest").select("band", "center", F.pmod(h, F.col("gp")).cast("int").alias("p"), upto("gq").alias("q"), "node", "known", "rest")
    b = rows.select("band", "center", upto("gp").alias("p"), F.pmod(h, F.col("gq")).cast("int").alias("q"), "node", "known", F.lit(False).alias("rest"))
    return a.union(b)


class _Cell:
    """One cell's rows as arrays, by node (the rest's side first where parts meet across)."""

    def __init__(self, rows: pa.Table):
        self.across = rows.column("rest")[0].is_valid
        rest = rows.column("rest").fill_null(False).to_numpy()
        order = np.lexsort((rows.column("node").to_numpy(), ~rest))
        self.order, self.n_rest = order, int(rest.sum()) if self.across else 0
        self.node, self.size = rows.column("node").to_numpy()[order], rows.column("size").to_numpy()[order]
        self.root = np.unique(rows.column("known").to_numpy()[order], return_inverse=True)[1]
        data = rows.column("payload").combine_chunks().take(pa.array(order)).to_pylist()
        fill = bytes(-len(data[0]) % 8)
        x = np.frombuffer(b"".join(d + fill for d in data), np.uint64).reshape(len(order), -1)
        self.words = np.ascontiguousarray(x.T)   # words by item, so that sums run along items

    def alike(self, i: int, close: Callable, open_only: bool = True) -> np.ndarray:
        """Later rows of the cell that may link with row ``i``; those of known parts only if another's."""
        lo = self.n_rest if self.across else i + 1
        at = lo + np.flatnonzero(self.root[lo:] != self.root[i]) if open_only else np.arange(lo, len(self.node))
        if len(at):
            at = at[close(self.words[:, i:i + 1], self.size[i], self.words[:, at], self.size[at])]
        return at

    def firsts(self) -> range:
        return range(self.n_rest if self.across else len(self.node) - 1)

    def join(self, i: int, j: int) -> None:
        self.root[self.root == self.root[j]] = self.root[i]


def alike_groups(cell: _Cell, close: Callable) -> np.ndarray:
    """A group number for each row of a cell that may link with another, else -1. Across
    parts, where some rows are joined already, all rows with a partner are one group."""
    group = np.full(len(cell.node), -1, np.int64)
    if cell.across:
        for i in cell.firsts():
            at = cell.alike(i, close)
            if len(at):
                group[i] = group[at] = 0
        return group
    for i in cell.firsts():
        at = cell.alike(i, close)
        while len(at):
            cell.join(i, at[0])
            at = at[cell.root[at] != cell.root[i]]
    _, back, count = np.unique(cell.root, return_inverse=True, return_counts=True)
    return np.where(count[back] > 1, back, -1)


def checked_links(cell: _Cell, sets: list[np.ndarray], close: Callable, same: Callable):
    """(a, b, shared, total) of enough links to join whatever links in one group."""
    for i in cell.firsts():
        for j in cell.alike(i, close):
            if cell.root[j] != cell.root[i]:
                ok, shared, total = same(sets[i], sets[j])
                if ok:
                    cell.join(i, j)
                    yield int(cell.node[i]), int(cell.node[j]), int(shared), int(total)


def _each(batches, keys: list[str]):
    """One table for each group of equal ``keys`` of a sorted stream that has two rows or more."""
    for table in whole_groups(batches, keys):
        change = np.zeros(len(table), bool)
        change[0] = True
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        first = np.append(np.flatnonzero(change), len(table))
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a > 1:
                yield table.slice(a, b - a)


def decided(cells: DataFrame, payload: DataFrame, close: Callable, sets_of: Callable, same: Callable, name: str) -> DataFrame:
    """Checked links (a, b, shared, total) of the cells."""
    def groups(batches):
        for table in _each(batches, CELL):
            cell = _Cell(table)
            group = np.empty(len(table), np.int64)
            group[cell.order] = alike_groups(cell, close)
            if (group >= 0).any():
                yield from table.select([*CELL, "node", "known", "rest", "size", "payload"]).append_column("g", pa.array(group)) \
                    .filter(pa.array(group >= 0)).to_batches()
    # Dealt by number: cells are small data but long work, and adaptive execution would put many into one task.
    dealt = spread(cells.join(payload, ["band", "node"]), *CELL).sortWithinPartitions(*CELL)
    some = staged(dealt.mapInArrow(groups, "band int, center long, p int, q int, node long, known long, rest boolean, "
                                   "size long, payload binary, g long"), f"{name}_groups")
    sets = sets_of(some.select("node").distinct())
    keys = [*CELL, "g"]

    def links(batches):
        for table in _each(batches, keys):
            cell = _Cell(table)
            items = table.column("items").combine_chunks()
            flat, off = items.flatten().to_numpy().view(np.uint64), items.offsets.to_numpy() - items.offsets[0].as_py()
            own = [flat[off[k]:off[k + 1]] for k in cell.order]
            got = list(checked_links(cell, own, close, same))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "b", "shared", "total"])
    dealt = spread(some.join(sets, "node"), *keys).sortWithinPartitions(*keys)
    return staged(dealt.mapInArrow(links, "a long, b long, shared long, total long"), f"{name}_links")


def links(members: DataFrame, payload: DataFrame, close: Callable, sets_of: Callable, same: Callable, name: str) -> tuple[DataFrame, DataFrame]:
    """(checked links (a, b, shared, total) that connect whatever is linked, (id, component) of their ends).

    ``payload`` has (band, node, size, payload binary), of one length in a band; it
    comes back filled up with zeros, as columns of 64-bit words. ``close(x, n, xs, ns)``
    says which of the others may link with the first; ``sets_of(nodes)`` returns (node,
    items array<bigint>) of some nodes; ``same(x, y)`` decides on two nodes' items (as
    unsigned) and returns (ok, shared, total)."""
    spark: SparkSession = members.sparkSession
    rows = staged(families_of(members, payload, name), f"{name}_families")
    found = decided(own_cells(rows), payload, close, sets_of, same, name)
    none = empty(spark, "id long, component long")
    parts = none if found.isEmpty() else components(found.select("a", "b"), name)
    if not rows.where("g > 1").isEmpty():
        across = staged(cross_cells(rows, parts, name), f"{name}_across")
        if not across.isEmpty():
            more = decided(across, payload, close, sets_of, same, f"{name}_across")
            if not more.isEmpty():
                found = found.unionByName(more)
                parts = components(found.select("a", "b"), name)
    return found, parts
