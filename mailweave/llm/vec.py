"""Numpy kernels over Arrow string buffers, used inside Spark tasks.

A batch of texts is taken as one flat UTF-8 byte buffer with document
offsets, so words, shingles and q-grams of many documents are hashed by a
handful of array operations and no Python object per word is made. Every
kernel is a pure function of the bytes: the same text gives the same numbers
in any batch, task or run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Text bytes handled at once; bounds the temporaries of a task (about 80 bytes each).
SLICE_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (splitmix64) on unsigned 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values for a seed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * U64(0x9E3779B97F4A7C15))


_BYTE = stream(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_COEF = stream(12, 64) | U64(1)
_BASE = 0x2545F4914F6CDD1D
_INV = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        a = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INV, U64)
        a[0] = 1
        _powers[kind] = np.cumprod(a, dtype=U64)
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any byte span."""
    h = np.empty(len(data) + 1, U64)
    h[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power("up", len(data)), dtype=U64, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * _power("down", len(h))[start] + (end - start).astype(U64))


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if off is not None else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last) row ranges of at most ``limit`` bytes, or one longer row."""
    at, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, min(to, n)
        at = to


def text_slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a record batch into (batch part, bytes, offsets)."""
    col = batch.column(batch.schema.get_field_index(column))
    data, off = buffers(col)
    for a, b in slices(np.diff(off), limit):
        yield batch.slice(a, b - a), data[off[a]:off[b]], off[a:b + 1] - off[a]


_NOT_WHITE = np.ones(256, bool)
_NOT_WHITE[list(WHITE)] = False


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every maximal run of non-white bytes."""
    return runs(_NOT_WHITE[data], off)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every maximal true run inside a document."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[off] = False
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[off] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return np.searchsorted(off, start, side="right") - 1, start, end


def shingles(doc: np.ndarray, h: np.ndarray, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``k`` words; a document with fewer
    words, but at least one, gives its whole sequence as one shingle."""
    count = np.bincount(doc, minlength=n_docs)
    n = len(h)
    out_d, out_h = [], []
    if n >= k:
        s = h[:n - k + 1] * _COEF[0]
        for j in range(1, k):
            s += h[j:n - k + 1 + j] * _COEF[j]
        ok = doc[:n - k + 1] == doc[k - 1:]
        out_d.append(doc[:n - k + 1][ok])
        out_h.append(mix(s[ok]))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        s = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = count[short] > j
            s[has] += h[first[short][has] + j] * _COEF[j]
        out_d.append(short)
        out_h.append(mix(s + count[short].astype(U64)))
    if not out_d:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(out_d).astype(np.int64), np.concatenate(out_h)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), ordered by both."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(doc):
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[keep], h[keep]
    return doc, h


def lists(doc: np.ndarray, values: np.ndarray, n_docs: int) -> pa.Array:
    """Arrow list column of ``values`` (ordered by document) per document."""
    off = np.zeros(n_docs + 1, np.int32)
    np.cumsum(np.bincount(doc, minlength=n_docs), out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))
