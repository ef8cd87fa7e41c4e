"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are compared as characters: lower-case letters and
digits, everything else one blank. An item is cut into windows of
half its length, ``MIN_WINDOW`` at least and ``MAX_WINDOW`` at most (the whole
item if it is shorter), so that every excerpt of 250 characters holds a window, starting at every quarter of a window and at its end. A document is
contaminated by an item if some window aligns with a part of the document with
at most ``floor(BUDGET * window)`` edits (fewer for very short windows, so that
the lemma still asks for one q-gram).

A window with k edits keeps at least W - Q + 1 - k * Q of its q-grams, on
diagonals that span at most k. So shared q-grams are counted in diagonal bands
of width 2k that overlap by k; only (document, item, band) regions that reach
the bound are aligned, by a banded dynamic program.

The benchmark is the query set: it is read in blocks of at most
``BLOCK_CHARS`` characters, each sent to the tasks once, and every block is
matched against all documents.

Defined cases: a null or empty text and an item with fewer than Q characters
match nothing; repeated rows give repeated results; an empty benchmark leaves
every document; other columns pass through unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chars, vec

Q, BUDGET, MIN_WINDOW, MAX_WINDOW = 10, 0.08, 100, 200
BLOCK_CHARS = 8_000_000

HITS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("item_start", T.IntegerType()),
    T.StructField("window", T.IntegerType()), T.StructField("doc_start", T.IntegerType()),
    T.StructField("edits", T.IntegerType())]))
HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("window", pa.int32()),
                                 ("doc_start", pa.int32()), ("edits", pa.int32())]))


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return chars.mapped(data, off, chars.byte_table())


def window_of(n: int) -> tuple[int, int, int]:
    """(window, edit budget, least shared q-grams) of an item of n characters."""
    w = min(n, max(MIN_WINDOW, min(MAX_WINDOW, (n + 1) // 2)))
    k = max(0, min(int(BUDGET * w), (w - Q) // Q))
    return w, k, w - Q + 1 - k * Q


def starts_of(n: int, w: int) -> list[int]:
    return sorted({*range(0, n - w + 1, max(1, w // 4)), n - w})


def grams(x: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q = 10 codes at every position (8 + 2 codes)."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.ascontiguousarray(x)
    first = np.ndarray((n,), "<u8", x, 0, (1,))
    rest = np.ndarray((n,), "<u2", x, 8, (1,))
    h = first * np.uint64(0x9E3779B97F4A7C15) + rest * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Sorted q-gram postings of one block of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items, self.shape, self.ids = [], [], []
        h, item, pos = [], [], []
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            x, _ = normal(data, np.array([0, len(data)]))
            if len(x) < Q:
                continue
            g = grams(x)
            h.append(g)
            item.append(np.full(len(g), len(self.items)))
            pos.append(np.arange(len(g)))
            self.items.append(x)
            self.ids.append(item_id)
            self.shape.append(window_of(len(x)))
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int64)
        bits = max(12, math.ceil(math.log2(len(h) + 1)) + 6)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True
        shape = np.array(self.shape or [(1, 0, 1)])
        self.budget, self.least = shape[:, 1], shape[:, 2]
        self.long = max([len(x) for x in self.items], default=0)

    def matches(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple]]:
        """{row: [hit, ...]} of a slice of texts."""
        if not self.items:
            return {}
        x, off = normal(data, off)
        g = grams(x)
        at = np.flatnonzero(self.seen[(g >> self.shift).astype(np.int64)])
        at = self._dense(at)
        if not len(at):
            return {}
        key = np.searchsorted(self.keys, g[at])
        key[key == len(self.keys)] = 0
        ok = self.keys[key] == g[at]
        at, key = at[ok], key[ok]
        doc = np.searchsorted(off, at, side="right") - 1
        ok = at + Q <= off[doc + 1]
        at, key, doc = at[ok], key[ok], doc[ok]
        if not len(at):
            return {}
        n = self.first[key + 1] - self.first[key]
        post = np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        item, pos = self.item[post], self.pos[post]
        diag = at - off[doc] - pos + self.long
        found: dict[int, dict] = {}
        for d, i, lo, where in self._regions(doc, item, diag, pos):
            if i not in found.get(d, {}) and (hit := self._verify(x[off[d]:off[d + 1]], i, lo - self.long, where)):
                found.setdefault(d, {})[i] = hit
        return {d: [v for _, v in sorted(h.items())] for d, h in found.items()}

    def _dense(self, at: np.ndarray) -> np.ndarray:
        """Hits that have at least the least count of any item within reach of one item."""
        t = int(self.least.min())
        if t <= 1 or len(at) < t:
            return at if t <= 1 else at[:0]
        near = at[t - 1:] - at[:len(at) - t + 1] <= self.long + 2 * int(self.budget.max())
        mark = np.zeros(len(at) + 1, np.int64)
        run = np.flatnonzero(near)
        np.add.at(mark, run, 1)
        np.add.at(mark, run + t, -1)
        return at[np.cumsum(mark)[:-1] > 0]

    def _regions(self, doc, item, diag, pos):
        """(row, item, first diagonal, item positions of the shared q-grams) of
        each band that reaches the item's bound, fullest first."""
        step = np.maximum(1, self.budget[item])
        out = []
        for shift in (0, 1):
            band = (diag // step + shift) // 2
            order = np.lexsort((pos, band, item, doc))
            a, b, c, p = doc[order], item[order], band[order], pos[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            one = new.copy()
            one[1:] |= p[1:] != p[:-1]
            a, b, c, p, new = a[one], b[one], c[one], p[one], new[one]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(a)))
            ok = count >= self.least[b[first]]
            for f, n in zip(first[ok], count[ok], strict=True):
                lo = int((2 * c[f] - shift) * max(1, self.budget[b[f]]))
                out.append((-int(n), int(a[f]), int(b[f]), lo, p[f:f + n]))
        out.sort(key=lambda r: r[:4])
        return [r[1:] for r in out]

    def _verify(self, text: np.ndarray, i: int, lo: int, where: np.ndarray):
        """The window of the item that aligns in the band [lo, lo + 2k), among those
        that reach the bound, fullest first; None if none does."""
        w, k, least = self.shape[i]
        whole = self.items[i]
        s = np.array(starts_of(len(whole), w))
        count = np.searchsorted(where, s + w - Q + 1) - np.searchsorted(where, s)
        width = 2 * max(1, k) + 2 * k
        for j in np.argsort(-count, kind="stable"):
            if count[j] < least:
                return None
            at = int(s[j])
            part, from_ = whole[at:at + w], max(0, at + lo - k)
            exact = text[from_:at + lo - k + width + w].tobytes().find(part.tobytes())
            edits, start = (0, from_ + exact) if exact >= 0 else banded(part, text, at + lo - k, width, k)
            if edits <= k:
                return self.ids[i], at, w, start, edits
        return None


def banded(pattern: np.ndarray, text: np.ndarray, lo: int, width: int, most: int) -> tuple[int, int]:
    """(edits, start as if both were of one length) of the best alignment of ``pattern`` with any part of
    ``text`` whose cells (i, j) keep j - i in [lo, lo + width]; stops early, with
    ``most + 1``, when no cell is left within ``most`` edits."""
    n = len(text)
    c = np.arange(width + 1)
    far = most + 1
    row = np.where((lo + c >= 0) & (lo + c <= n), 0, far)
    for i, p in enumerate(pattern, 1):
        j = i + lo + c
        ok = (j >= 1) & (j <= n)
        same = np.zeros(width + 1, bool)
        same[ok] = text[j[ok] - 1] == p
        up = np.append(row[1:], far) + 1
        new = np.minimum(np.where(ok, row + ~same, far), up)
        new = np.where((j >= 0) & (j <= n), new, far)
        new = np.minimum.accumulate(new - c) + c
        row = np.where((j >= 0) & (j <= n), np.minimum(new, far), far)
        if row.min() > most:
            return far, 0
    return int(row.min()), max(0, lo + int(row.argmin()))


def blocks(benchmark: DataFrame):
    """Bounded blocks of (item_id, text)."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield [(r.item_id, r.text) for r in items.where(block == b).orderBy("item_id", "text").collect()]


def scan(docs: DataFrame, rows: list[tuple[int, str]], columns: list[str], clean_only: bool) -> DataFrame:
    """Documents (``columns``, the text among them) matched against one block: those with hits and a
    column ``_hits``, or, with ``clean_only``, those without."""
    told = docs.sparkSession.sparkContext.broadcast(rows)
    fields = docs.select(*columns).schema.fields
    schema = T.StructType(fields if clean_only else [f for f in fields if f.name != "text"] + [T.StructField("_hits", HITS)])
    held: list[Index] = []

    def run(batches):
        if not held:
            held.append(Index(told.value))
        for b in batches:
            for part, data, off in vec.text_slices(b):
                found = held[0].matches(data, off)
                if clean_only:
                    keep = np.ones(len(part), bool)
                    keep[list(found)] = False
                    yield part.filter(pa.array(keep))
                elif found:
                    at = sorted(found)
                    part = part.take(pa.array(at))
                    hits = pa.array([[dict(zip(HITS_ARROW.value_type.names, h, strict=True)) for h in found[r]]
                                     for r in at], HITS_ARROW)
                    cols = [part.column(i) for i, f in enumerate(fields) if f.name != "text"]
                    yield pa.RecordBatch.from_arrays([*cols, hits], names=schema.names)
    return docs.select(*columns).mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_start, window, doc_start, edits): the best window
    of every item that contaminates a document. Positions count normalised
    characters."""
    out = None
    for rows in blocks(benchmark):
        part = scan(docs, rows, ["doc_id", "text"], False).select("doc_id", F.inline("_hits"))
        out = part if out is None else out.union(part)
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, all columns unchanged."""
    for rows in blocks(benchmark):
        docs = scan(docs, rows, docs.columns, True)
    return docs
