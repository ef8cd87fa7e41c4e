"""Importance resampling of documents towards a target distribution.

Texts become bags of hashed word n-grams; a bucket's gain is the log ratio of its
share in the target texts to its share in the corpus, a document's weight the mean
gain of its features, and Gumbel noise on the weights turns "take the best" into
a draw without replacement in proportion to the importance weights.

All text work is Arrow kernels on slices of a batch: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` give each word a
number; n-grams are pairs (number of the shorter gram, number of the word after
it), numbered in turn by their distinct pairs; only distinct grams are written out
and hashed; buckets and gains come back by ``take`` and are summed per document.

Two scans of the corpus: one adds up bucket counts inside each task (``buckets``
numbers a task, whatever it reads), one weighs the documents. The counts of all
tasks are added up by Spark; the driver sees ``buckets`` numbers. The draw orders
(score, doc_id) by range partitions, so no task ranks all documents.

Defined cases: a null text has no words and weight 0; the text is never cut; a
null doc_id is drawn by the hash of ``<seed>:`` and comes last among equal scores;
equal scores go to the smaller doc_id, then to the smaller hash of the text, so
that of equal rows any one comes first with the same result; repeated rows are rows
of their own; an empty table gives no rows and an empty target gives every bucket
its smoothed share; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged
from .vec import text_slices

#: What stands between words, once A-Z are lower case (bytes outside ASCII belong to words).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Text bytes handled at once (some 25 bytes of temporaries each); a longer text is handled alone.
SLICE_BYTES = 4_000_000


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(batch part, its texts), some ``SLICE_BYTES`` at a time; null is empty. Each part's
    offsets start at 0: of others ``ascii_lower`` reads the wrong bytes."""
    for part, data, off in text_slices(batch, limit=SLICE_BYTES):
        yield part, pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(off), pa.py_buffer(data))


def features(text: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, document of each feature, bucket of each feature)."""
    words = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    doc = pc.list_parent_indices(words).to_numpy()
    code = pc.list_flatten(words).dictionary_encode()
    vocabulary, number = code.dictionary, code.indices.to_numpy().astype(np.int64)
    blank = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if blank >= 0:   # what stands before the first and after the last word
        doc, number = doc[number != blank], number[number != blank]
    n_words = np.bincount(doc, minlength=len(text))
    strings, at, gram_at = vocabulary, np.arange(len(doc)), number
    docs, out = [], []
    for n in range(1, longest + 1):
        if n > 1:   # the shorter gram and the word after it, of one document
            at = np.flatnonzero(doc[:max(0, len(doc) - n + 1)] == doc[n - 1:])
            pair, back = np.unique(gram_at[at] * len(vocabulary) + number[at + n - 1], return_inverse=True)
            v = max(1, len(vocabulary))
            strings = pc.binary_join_element_wise(strings.take(pa.array(pair // v)), vocabulary.take(pa.array(pair % v)), pa.scalar(" ", strings.type))
            gram_at = np.full(len(doc), -1, np.int64)
            gram_at[at] = back
        hashed = np.fromiter((zlib.crc32(s.as_buffer()) % buckets for s in strings), np.int64, len(strings))
        docs.append(doc[at])
        out.append(hashed.take(gram_at[at]))
    return n_words, np.concatenate(docs), np.concatenate(out)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, text in texts_of(batch):
                total += np.bincount(features(text, buckets, longest)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    got = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in whole thousandths."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n))))
                     for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Whole thousandths of standard Gumbel noise, fixed by seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight) of every document."""
    def run(batches):
        for batch in batches:
            for part, text in texts_of(batch):
                n_words, doc, bucket = features(text, len(gain), longest)
                count = np.bincount(doc, minlength=len(part)).astype(np.int64)
                if longest > 1:
                    order = np.argsort(doc, kind="stable")
                    bucket = bucket[order]
                total = np.append(0, np.cumsum(gain.take(bucket)))
                end = np.cumsum(count)
                weight = (total[end] - total[end - count]) // np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n_words.astype(np.int64)),
                                                  pa.array(count), pa.array(weight)],
                                                 names=["doc_id", "tie", "n_words", "n_features", "weight"])
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).mapInArrow(
        run, "doc_id long, tie long, n_words long, n_features long, weight long")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
          buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, name: str = "op11") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: ``rank`` numbers
    the drawn ``percent`` of the documents that have ``least_words`` words or more."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = weighed(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = staged(rows.withColumn("_short", F.col("n_words") < least_words), f"{name}_weighed")
    draw = rows.select(F.floor(F.count_if(~F.col("_short")) * percent / 100).cast("long")).scalar()
    order = [F.col("_short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    placed = ranked(rows, order, f"{name}_ranked")
    return placed.select("doc_id", "n_features", "weight", "score",
                         F.when(~F.col("_short") & (F.col("rank") < draw), (F.col("rank") + 1).cast("long")).alias("rank"))


#: DuckDB SQL of the query. CRC-32 has no function there: the table of 256 remainders is made by its rule, then bytes
#: of each distinct word are folded in.
SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)),
       lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
doc AS (SELECT doc_id, row_number() OVER () AS row_no, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
bench AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS word FROM benchmark),
feature AS (SELECT row_no, unnest(words) AS word FROM doc),
word AS (SELECT DISTINCT word FROM (SELECT word FROM feature UNION ALL SELECT word FROM bench)),
bytes AS (SELECT word, hex(encode(word)) AS h FROM word),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i:
       (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
       lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS n FROM feature JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bench JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (SELECT CAST(coalesce(sum(n), 0) + 10000 AS DOUBLE) FROM s))
       / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * (SELECT CAST(coalesce(sum(n), 0) + 10000 AS DOUBLE) FROM t)))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (bucket)),
mean AS (SELECT row_no, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM feature JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row_no),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
       (list_reduce(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(sha256(concat('2024:', doc_id)), i + 1, 1)) - 1 AS BIGINT)),
       lambda a, b: a * 16 + b) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN mean USING (row_no)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN n_features >= 20 AND r <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank
FROM placed
"""
