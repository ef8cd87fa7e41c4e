"""Substring dedup by repeated sentence spans.

A text is cut into sentences: at line ends, after words that end in . ! or ?, and,
where ``WINDOW`` words in a row have no such end, after the one of least hash (so
that cuts depend on the words nearby only, and a passage is cut alike wherever it
stands). From every sentence starts one span: the shortest run of at least ``RUN``
sentences and ``MIN_WORDS`` words. Every passage of 3 ``WINDOW`` + ``MIN_WORDS`` - 1
= 50 words holds a whole span, wherever it begins and ends: its first ``WINDOW``
words hold a cut, after which no word outside of it makes another one until
``WINDOW`` words before its end; sentences have ``WINDOW`` words at most, so the span
from that cut ends within ``MIN_WORDS`` + ``WINDOW`` - 1 words, or after
``RUN`` times ``WINDOW``, which is less. The words before the first and after the last common cut
stay. Spans are hashed word by word (ASCII letters lower-cased), by two independent
64-bit hashes, and joined over all documents; the first occurrence, by doc_id and
place, stays, and every sentence that another occurrence covers is removed.

Spans are counted first by hash alone; a fixed-size bitmap of the repeated
hashes then keeps all other spans from being shuffled with their places.

Defined cases: a null text stays null, with no sentences; a text shorter than a
span loses nothing unless a longer one covers it, so never; equal spans in one
document count too; documents with a null doc_id come last; rows equal in doc_id
and text are one document and are treated alike; an empty table gives no rows;
other columns are ignored, or pass through ``keep`` (a name of the result wins).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import families, vec
from .common import staged

RUN, MIN_WORDS, WINDOW = 2, 15, 12
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def least_in_windows(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Index of the least rank, the last of equal ones, of every ``WINDOW`` neighbours inside a document."""
    n = len(rank) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = rank[:n].copy(), np.arange(n)
    for j in range(1, WINDOW):
        below = rank[j:j + n] <= least
        least[below] = rank[j:j + n][below]
        at[below] = np.flatnonzero(below) + j
    return at[doc[:n] == doc[WINDOW - 1:]]


def sentences(data: np.ndarray, off: np.ndarray):
    """(document, first byte, first word, words' hash, sentence of each word) of every sentence."""
    doc, start, end = vec.words(data, off)
    n = len(doc)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), z
    h = vec.span_hash(vec.prefix_hash(data, True), start, end)
    line = np.append(0, np.cumsum(data == 10))
    last = _END[data[end - 1]]
    last[:-1] |= (line[start[1:]] > line[end[:-1]]) & (doc[1:] == doc[:-1])
    last[least_in_windows(np.where(last, np.uint64(0), h | np.uint64(1)), doc)] = True
    last[:-1] |= doc[1:] != doc[:-1]
    last[-1] = True
    number = np.append(0, np.cumsum(last)[:-1])
    first = np.flatnonzero(np.append(True, last[:-1]))
    return doc[first], start[first], first, h, number


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, span hash, first sentence, sentence after the last, second hash), sentences counted inside the document."""
    doc, _, first, h, number = sentences(data, off)
    m = len(doc)
    i = np.arange(m)
    reach = first + MIN_WORDS - 1
    last = np.maximum(np.where(reach < len(h), number[np.minimum(reach, len(h) - 1)], m) if m else i, i + RUN - 1)
    ok = last < m
    i, last = i[ok], last[ok]
    ok = doc[i] == doc[last]
    i, last = i[ok], last[ok]
    a, b = first[i], np.append(first, len(h))[last + 1]
    up, down = vec._power("up", len(h)), vec._power("down", len(h) + 1)

    def hashed(word):
        total = np.append(np.uint64(0), np.cumsum(word * up, dtype=np.uint64))
        return vec.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    base = np.searchsorted(doc, np.arange(len(off) - 1))
    return doc[i], hashed(h), i - base[doc[i]], last + 1 - base[doc[i]], hashed(vec.mix(h + np.uint64(0x9E3779B97F4A7C15)))


def repeats(docs: DataFrame, name: str = "spans") -> DataFrame:
    """(doc_id, tie, cuts, first_docs): for each document that loses sentences the
    sentence ranges, and the documents in which their spans occur first."""
    def hashes(batches):
        for b in batches:
            for _, data, off in vec.text_slices(b):
                yield pa.RecordBatch.from_arrays([pa.array(spans(data, off)[1].view(np.int64))], names=["key"])
    seen = docs.select("text").mapInArrow(hashes, "key long").groupBy("key").count().where("count > 1")
    told = docs.sparkSession.sparkContext.broadcast(families.bitmap(seen, "key"))

    def places(batches):
        words = np.frombuffer(told.value, np.uint32)
        for b in batches:
            for part, data, off in vec.text_slices(b):
                doc, key, a, z, key2 = spans(data, off)
                hit = families.passes(words, key)
                doc = pa.array(doc[hit])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(doc), part.column(2).take(doc), pa.array(key[hit].view(np.int64)),
                     pa.array(a[hit].astype(np.int32)), pa.array(z[hit].astype(np.int32)), pa.array(key2[hit].view(np.int64))],
                    names=["doc_id", "tie", "key", "first", "after", "key2"])
    at = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(
        places, "doc_id long, tie long, key long, first int, after int, key2 long")
    at = staged(at.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "first")), f"{name}_at")
    first = staged(at.groupBy("key", "key2").agg(F.min("place").alias("origin"), F.max("place").alias("_last"))
                   .where("origin < _last").select("key", "key2", "origin"), f"{name}_first")
    again = at.join(first, ["key", "key2"]).where("place > origin")
    mine = F.collect_set(F.when(~F.col("origin.doc_id").eqNullSafe(F.col("doc_id")), F.col("origin.doc_id")))
    return again.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("first", "after")).alias("cuts"),
                                             F.array_sort(mine).alias("first_docs"))


def cut(data: np.ndarray, off: np.ndarray, cuts: pa.ListArray):
    """(kept bytes, their offsets, sentences, removed sentences) of a slice of
    texts and the sentence ranges to remove from each."""
    doc, start, *_ = sentences(data, off)
    n = len(off) - 1
    base = np.searchsorted(doc, np.arange(n + 1))
    size = cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row, ranges = np.repeat(np.arange(n), size), cuts.flatten()
    drop = np.zeros(len(doc) + 1, np.int64)
    np.add.at(drop, base[row] + ranges.field("first").to_numpy(), 1)
    np.add.at(drop, base[row] + ranges.field("after").to_numpy(), -1)
    drop = np.cumsum(drop)[:-1] > 0
    stop = np.append(start[1:], len(data))
    stop = np.minimum(stop, off[doc + 1]) if len(doc) else stop[:0]
    keep = np.zeros(len(data) + 1, np.int32)
    np.add.at(keep, start[drop], 1)
    np.add.at(keep, stop[drop], -1)
    keep = np.cumsum(keep)[:-1] == 0
    at = np.append(0, np.cumsum(keep))
    return data[keep], at[off], np.diff(base), np.bincount(doc[drop], minlength=n)


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = (), name: str = "spans") -> DataFrame:
    """(doc_id, ``keep``, text, n_sentences, n_removed, first_docs) of every
    document, its text without the sentences that repeat an earlier span."""
    keep = tuple(c for c in keep if c.lower() not in ("doc_id", "text", "n_sentences", "n_removed", "first_docs"))
    lost = staged(repeats(docs, name), f"{name}_lost")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    lost = lost.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    d = d.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    d = d.select("doc_id", "text", "cuts", "first_docs", *[f"_keep_{c}" for c in keep])
    schema = T.StructType([d.schema["doc_id"], T.StructField("text", T.StringType()),
                           T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()),
                           d.schema["first_docs"], *[T.StructField(c, docs.schema[c].dataType) for c in keep]])

    def run(batches):
        for b in batches:
            for part, data, off in vec.text_slices(b):
                raw, at, count, gone = cut(data, off, part.column(2))
                text = pa.StringArray.from_buffers(len(part), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
                text = pc.if_else(pc.is_null(part.column(1)), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([part.column(0), text, pa.array(count), pa.array(gone), *part.columns[3:]],
                                                 names=schema.names)
    return d.mapInArrow(run, schema)
