"""Alignment of two tokenizers' tokens over a corpus.

Both tokenizers cut the same bytes, so a text's tokens fall into the finest groups
whose ends both share, and every pair of overlapping tokens is a link. Groups are
found by diagonal run skipping (``diagonal``): while the two arrays of ends agree
at the current index shift, exponentially growing slices of them are compared and
whole one-to-one stretches are jumped; where they disagree, the irregular group is
resolved locally by advancing the side that ends first, and the shift changes.

No token of either tokenizer crosses the place before a space that follows a
character other than white space. Texts are cut there, and each distinct piece of a
block of texts is encoded and aligned once; a text is the sequence of its pieces.

Corpus-wide counts never pass through one place: a block (``BLOCK_BYTES`` of text,
or one longer text) hands on its distinct (A id, B id) pairs with their counts,
Spark adds them up by pair, finds the highest of each B id, and gives each block
its own pairs back, where they are summed over the block's pieces and texts.

The tokenizer files are read by the driver from the folder given and handed to
the tasks (some 3 MB whatever the corpus); they are not part of the library.

Defined cases: a null or empty text, and one whose tokens do not spell it exactly
(U+2581 in a text reads as a space), has no tokens: zeros and an empty digest;
special tokens' strings are plain text; texts are never cut short; repeated rows
count again, and each gets its own row; a null doc_id stays null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import staged

TOKENIZERS = "/opt/tokenizers"
#: Text bytes of a block; distinct pieces encoded at once; bytes of group strings held at once.
BLOCK_BYTES, ENCODED, DIGEST_BYTES = 4_000_000, 4_000, 8_000_000


# ------------------------------------------------------------------ the two tokenizers
def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's letter of every byte: printable bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encoder of one tokenizer: ids of a list of pieces (each begins with a space)
    and the bytes of every id."""

    def __init__(self, kind: str, blob: bytes):
        if kind == "byte":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            made = Tokenizer.from_str(blob.decode())
            made.encode_special_tokens = True
            letters, entries = byte_alphabet(), made.get_vocab(with_added_tokens=True)
            spelled = [b""] * (max(entries.values()) + 1)
            for entry, i in entries.items():
                spelled[i] = bytes(letters[c] for c in entry)
            self._encode = lambda pieces: [e.ids for e in made.encode_batch_fast(pieces, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor
            model = SentencePieceProcessor(model_proto=blob)
            spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                       for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
            self._encode = lambda pieces: model.encode([p[1:] for p in pieces], num_threads=1)   # it adds the space
        self.spelled = pa.array(spelled, pa.large_binary())
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.inner = [f"{i}," for i in range(len(spelled))]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has)."""
        ids, count = [], np.zeros(len(pieces), np.int64)
        for at in range(0, len(pieces), ENCODED):
            got = self._encode(pieces[at:at + ENCODED])
            count[at:at + len(got)] = [len(x) for x in got]
            ids.append(np.fromiter(chain.from_iterable(got), np.int64))
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), count

    def spells(self, ids: np.ndarray, count: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Which pieces their tokens' bytes spell exactly."""
        said, off = vec_buffer(self.spelled.take(pa.array(ids)))
        end = np.cumsum(count)
        start = end - count
        return np.fromiter((said[off[a]:off[b]] == p.encode() for a, b, p in zip(start.tolist(), end.tolist(), pieces, strict=True)),
                           bool, len(pieces))


def vec_buffer(col: pa.Array) -> tuple[memoryview, list[int]]:
    """(bytes, offsets) of a large binary array."""
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8).tolist() if len(col) else [0]
    return (memoryview(data).cast("B") if data is not None else memoryview(b"")), off


_CODERS: dict[str, Coder] = {}


def coder(kind: str, blob: bytes) -> Coder:
    """The tokenizer of a file's content, made once in a Python worker."""
    key = kind + hashlib.sha256(blob).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(kind, blob)
    return _CODERS[key]


# ------------------------------------------------------------------ alignment
def diagonal(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last A, last B) token of every group and (A, B) token of every link, by order
    of place; ``a`` and ``b`` are ascending ends whose last ones are equal."""
    runs, ends, li, lj = [], [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        i0, j0, step, growing = i, j, 1, True
        while step:
            if i + step <= n and a[i:i + step] == b[j:j + step]:
                i += step
                j += step
                step = step * 2 if growing else step // 2
            else:
                growing = False
                step //= 2
        if i > i0:
            runs.append((i0, j0, i - i0))
        if i < n:
            x, y = a[i], b[j]
            while True:
                li.append(i)
                lj.append(j)
                if x < y:
                    i += 1
                    x = a[i]
                elif y < x:
                    j += 1
                    y = b[j]
                else:
                    break
            ends.append((i, j))
            i += 1
            j += 1
    run, end = np.array(runs, np.int64).reshape(-1, 3), np.array(ends, np.int64).reshape(-1, 2)
    step = np.arange(run[:, 2].sum()) - np.repeat(np.cumsum(run[:, 2]) - run[:, 2], run[:, 2])
    ri, rj = np.repeat(run[:, 0], run[:, 2]) + step, np.repeat(run[:, 1], run[:, 2]) + step
    group = np.argsort(np.concatenate([ri, end[:, 0]]), kind="stable")
    la, lb = np.concatenate([ri, np.array(li, np.int64)]), np.concatenate([rj, np.array(lj, np.int64)])
    link = np.argsort(la + lb, kind="stable")   # a link's successor is one further on one side or on both
    return np.concatenate([ri, end[:, 0]])[group], np.concatenate([rj, end[:, 1]])[group], la[link], lb[link]


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text's begin and before a space after a byte that
    ends no white space (of other bytes than ASCII, only those sure to be none)."""
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data[:-k]])[:len(data)] for k in (1, 2, 3))
    plain = (one > 32) & (one < 127)
    other = (one >= 128) & ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) & ~((three >= 0xE1) & (three <= 0xE3))
    begin = (data == 32) & (plain | other)
    begin[off[1:][np.diff(off) > 0] - 1] = False   # a last space alone would be no text for the one that adds a space
    begin[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(begin)


ROW = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "pieces array<int>, times array<int>, "
       "pair_a array<int>, pair_b array<int>, pair_n array<bigint>, links array<int>, starts array<int>")
#: The columns of a text's row; the others hold what is known of a block (one row each, without pieces).
TEXT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def segments(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of ``count`` values each."""
    total = np.append(0, np.cumsum(values))
    end = np.cumsum(count)
    return total[end] - total[end - count]


def encoded_block(block: int, ids: pa.Array, text: pa.Array, a: Coder, b: Coder) -> Iterator[pa.RecordBatch]:
    """ROWs of one block of texts."""
    n_docs = len(text)
    data, off = vec.buffers(text)
    some = np.diff(off) > 0
    grown = np.full(len(data) + int(some.sum()), 32, np.uint8)   # a space before every text
    new_off = off + np.append(0, np.cumsum(some))
    keep = np.ones(len(grown), bool)
    keep[new_off[:-1][some]] = False
    grown[keep] = data
    start = cuts(grown, new_off)
    piece = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(grown)).astype(np.int64)),
                                             pa.py_buffer(grown)).dictionary_encode()
    code, pieces = piece.indices.to_numpy().astype(np.int64), piece.dictionary.to_pylist()
    doc = np.searchsorted(new_off, start, side="right") - 1
    ia, ca = a.encode(pieces)
    ib, cb = b.encode(pieces)
    good = a.spells(ia, ca, pieces) & b.spells(ib, cb, pieces)
    sound = some.copy()
    sound[doc[~good[code]]] = False
    code, doc = code[sound[doc]], doc[sound[doc]]
    used = np.bincount(code, minlength=len(pieces))
    ia, ib = ia[np.repeat(good, ca)], ib[np.repeat(good, cb)]
    ca, cb = np.where(good, ca, 0), np.where(good, cb, 0)
    ga, gb, la, lb = diagonal(np.cumsum(a.length[ia]).tolist(), np.cumsum(b.length[ib]).tolist())
    of_a = np.repeat(np.arange(len(pieces)), ca)
    cg, cl = np.bincount(of_a[ga], minlength=len(pieces)), np.bincount(of_a[la], minlength=len(pieces))

    # decimal ids in order of groups, each with the sign that follows it: "a1,a2|b1;"
    table = pa.array(a.inner + [s[:-1] + "|" for s in a.inner] + b.inner + [s[:-1] + ";" for s in b.inner], pa.large_string())
    ends_a, ends_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    ends_a[ga] = 1
    ends_b[gb] = 1
    key_a, key_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    order = np.argsort(np.concatenate([2 * key_a, 2 * key_b + 1]), kind="stable")
    shown = table.take(pa.array(np.concatenate([ia + ends_a * len(a.inner), 2 * len(a.inner) + ib + ends_b * len(b.inner)])[order]))
    said, said_off = vec_buffer(shown.cast(pa.large_binary()))
    at = np.array(said_off)[np.append(0, np.cumsum(ca + cb))]
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(said)])
    size = np.diff(at)
    counts = np.bincount(doc, minlength=n_docs)
    first = np.append(0, np.cumsum(counts))
    digest = [""] * n_docs
    for x, y in vec.slices(segments(size[code], counts), DIGEST_BYTES):
        joined, joined_off = vec_buffer(strings.take(pa.array(code[first[x]:first[y]])))
        for d in range(x, y):
            if counts[d]:
                digest[d] = hashlib.sha256(joined[joined_off[first[d] - first[x]]:joined_off[first[d + 1] - first[x]] - 1]).hexdigest()

    pair, which = np.unique(ia[la] << 32 | ib[lb], return_inverse=True)
    pair_n = np.bincount(which, used[of_a[la]], len(pair)).astype(np.int64)   # exact below 2 ** 53
    kept = pair_n > 0
    place = np.cumsum(kept) - 1
    in_use = np.repeat(used > 0, cl)
    mixed, times = np.unique(doc * max(1, len(pieces)) + code, return_counts=True)
    mixed_doc, mixed_code = mixed // max(1, len(pieces)), mixed % max(1, len(pieces))
    nothing = lambda kind: pa.nulls(n_docs, pa.list_(kind))
    names = [c.split()[0] for c in ROW.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n_docs, block)), ids, *[pa.array(segments(c[code], counts).astype(np.int64)) for c in (ca, cb, cg, cl)],
         pa.array(digest, pa.string()), vec.lists(mixed_doc, mixed_code.astype(np.int32), n_docs),
         vec.lists(mixed_doc, times.astype(np.int32), n_docs), nothing(pa.int32()), nothing(pa.int32()), nothing(pa.int64()),
         nothing(pa.int32()), nothing(pa.int32())], names=names)
    if kept.any():
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        none = [pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.string())] + [pa.nulls(1, pa.list_(pa.int32()))] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), *none, one((pair[kept] >> 32).astype(np.int32), pa.int32()),
             one((pair[kept] & 0xFFFFFFFF).astype(np.int32), pa.int32()), one(pair_n[kept], pa.int64()),
             one(place[which][in_use].astype(np.int32), pa.int32()),
             one(np.append(0, np.cumsum(np.where(used > 0, cl, 0))).astype(np.int32), pa.int32())], names=names)


def encoded(docs: DataFrame, folder: str) -> DataFrame:
    """ROW of every document and block."""
    def content(name):
        with open(f"{folder}/{name}", "rb") as f:
            return f.read()
    told = docs.sparkSession.sparkContext.broadcast((content("byte_bpe_50k.json"), content("piece_bpe_32k.model")))

    def run(batches):
        a, b = coder("byte", told.value[0]), coder("piece", told.value[1])
        held, size, block = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            rows = pa.Table.from_batches(held)
            yield from encoded_block(block, rows.column("doc_id").combine_chunks(),
                                     pa.concat_arrays([x.fill_null("") for x in rows.column("text").chunks]), a, b)
        for batch in batches:
            for part, data, _ in vec.text_slices(batch, limit=BLOCK_BYTES):
                if held and size + len(data) > BLOCK_BYTES:
                    yield from flush()
                    pa.default_memory_pool().release_unused()
                    held, size, block = [], 0, block + 1
                held.append(part)
                size += len(data)
        if held:
            yield from flush()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROW)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair_a, pair_b, total, best) of the whole corpus; best: no pair of that B id has more links."""
    part = rows.where("pair_a is not null").select(F.inline(F.arrays_zip("pair_a", "pair_b", "pair_n")))
    total = part.groupBy("pair_a", "pair_b").agg(F.sum("pair_n").alias("total"))
    return total.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("pair_b")))


def aligned(docs: DataFrame, folder: str = TOKENIZERS, name: str = "op12") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    rows = staged(encoded(docs, folder), f"{name}_encoded")
    own = rows.where("pair_a is not null").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("pos", "p"))
    own = own.select("block", "pos", F.col("p.pair_a").alias("pair_a"), F.col("p.pair_b").alias("pair_b"))
    told = own.join(pair_counts(rows), ["pair_a", "pair_b"]).select(F.col("block").alias("of_block"), "pos", "total", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_text = left.column("pieces").is_valid().to_numpy()
        text, known = left.filter(pa.array(is_text)), left.filter(pa.array(~is_text))
        lists = text.column("pieces").combine_chunks()
        code, times = lists.flatten().to_numpy().astype(np.int64), text.column("times").combine_chunks().flatten().to_numpy()
        sums = [np.zeros(0, np.int64)] * 2
        if len(known):
            at = right.column("pos").to_numpy()
            start = known.column("starts")[0].values.to_numpy().astype(np.int64)
            links = known.column("links")[0].values.to_numpy()
            for k, c in enumerate(("best", "total")):
                value = np.zeros(right.num_rows, np.int64)
                value[at] = right.column(c).to_numpy()
                run_up = np.append(0, np.cumsum(value[links]))
                sums[k] = run_up[start[1:]] - run_up[start[:-1]]
        count = lists.value_lengths().to_numpy()
        best, total = (segments(s[code] * times, count) if len(known) else np.zeros(len(text), np.int64) for s in sums)
        cols = {c: text.column(c) for c in TEXT} | {"n_best": pa.array(best), "count_sum": pa.array(total)}
        return pa.table([cols[c.split()[0]] for c in out.split(", ")], names=[c.split()[0] for c in out.split(", ")])
    left = rows.select("block", *TEXT, "pieces", "times", "links", "starts")
    return left.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(run, out)
