"""Arrow and numpy kernels that cut normalized texts into words and their positions, or into
runs of three characters, used inside Spark tasks on a slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once (some 20 bytes of temporaries each); a longer text is handled alone.
SLICE_BYTES = 4_000_000


def text_parts(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(batch part, its texts), some ``most`` (``SLICE_BYTES``) bytes at a time; null is empty. Offsets of
    each part start at 0: of others some kernels read the wrong bytes."""
    col = batch.column(column).fill_null("").cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + (most or SLICE_BYTES), side="right")) - 1)
        yield batch.slice(a, b - a), pa.LargeStringArray.from_buffers(
            b - a, pa.py_buffer(off[a:b + 1] - off[a]), pa.py_buffer(data[off[a]:off[b]]))
        a = b


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text; each word's text, place in it and number; the words
    by number) of normalized texts: words are separated by one blank."""
    words = pc.split_pattern(text, " ")
    row = pc.list_parent_indices(words).to_numpy()
    code = pc.list_flatten(words).dictionary_encode()
    vocabulary, number = code.dictionary, code.indices.to_numpy().astype(np.int64)
    blank = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if blank >= 0:   # what stands before the first and after the last word
        row, number = row[number != blank], number[number != blank]
    dl = np.bincount(row, minlength=len(text))
    return dl, row, np.arange(len(row)) - (np.cumsum(dl) - dl)[row], number, vocabulary


def runs_of(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(number of words, runs) of normalized texts. A text without words has null runs."""
    dl, row, place, number, vocabulary = words_of(text)
    by_name = np.empty(len(vocabulary), np.int64)                    # numbers in the order of the terms
    by_name[pc.sort_indices(vocabulary).to_numpy()] = np.arange(len(vocabulary))
    key = row * max(1, len(vocabulary)) + by_name[number]
    order = np.argsort(key, kind="stable")                           # so that positions of a run ascend
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    terms = vocabulary.take(pa.array(number[order[starts]])).cast(pa.string())
    ends = np.append(0, np.cumsum(np.bincount(row[order[starts]], minlength=len(text))))
    runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([terms, positions], names=["term", "positions"]),
                                    mask=pa.array(dl == 0))
    return pa.array(dl, pa.int32()), runs


def lists(starts: np.ndarray, total: int, items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, total), pa.int32()), items)


def gram_hashes(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, first word, 64-bit hash) of each text's distinct runs of n words, with the
    words' numbers and the words by number."""
    dl, row, place, number, vocabulary = words_of(text)
    one = pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False), categorize=False) if len(vocabulary) else np.zeros(0, np.uint64)
    first = np.flatnonzero(place + n <= dl[row])
    h = np.zeros(len(first), np.uint64)
    for i in range(n):
        h = (h ^ one[number[first + i]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.lexsort((h, row[first]))
    first, h = first[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[first[1:]] != row[first[:-1]]))[:len(h)]
    return row[first[new]], first[new], h[new], number, vocabulary


def trigrams_of(text: pa.LargeStringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(runs of three characters, where each one's texts start and the last one's end, numbers
    of the texts that hold it): runs ascend by code points, each one's texts ascend, once each.
    The texts' offsets start at 0 (``text_parts``)."""
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64, len(text) + 1)
    data = memoryview(data)[:off[-1]] if data is not None else b""
    chars = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    if len(chars) < len(data):       # from bytes to the characters that begin there
        off = np.append(0, np.cumsum(np.frombuffer(data, np.int8) >= -64))[off]
    row = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(off))
    at = np.flatnonzero(row[:-2] == row[2:])              # a run lies in one text
    seen = np.zeros(int(chars.max(initial=0)) + 1, bool)
    seen[chars] = True
    alphabet, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[chars]
    n, pairs = len(alphabet), None
    pair = code[at] * n + code[at + 1]
    if n ** 3 * len(text) >= 1 << 63:
        pairs, pair = np.unique(pair, return_inverse=True)
    key = (pair * n + code[at + 2]) * len(text) + row[at]
    if n ** 3 * len(text) < 1 << 32:
        key = key.astype(np.uint32)  # sorts in half the time
    key.sort()
    gram, place = np.divmod(key[np.flatnonzero(np.diff(key, prepend=key[:1] + 1))].astype(np.int64), max(1, len(text)))
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    pair, third = np.divmod(gram[starts], max(1, n))
    first, second = np.divmod(pair if pairs is None else pairs[pair], max(1, n))
    runs = alphabet[np.stack([first, second, third], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
    return [runs[i:i + 3] for i in range(0, len(runs), 3)], np.append(starts, len(place)), place
