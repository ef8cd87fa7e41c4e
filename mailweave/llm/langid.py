"""Language identification by interpolated Kneser-Ney character models.

Texts are sequences of lower-case letters, everything else one blank, with
``ORDER - 1`` blanks before the first character. Each language has a model of
orders 1 to ``ORDER``: raw counts at the highest order, counts of distinct left
neighbours below, one absolute discount per order. For every order the n-grams
of all languages stand in one sorted hash array, beside it the finished
probability under each language, so a character costs one binary search in most
cases; n-grams that no language has seen back off through a sorted array of
context weights.

The prediction is the language of the lowest cross-entropy per character. The
score is a posterior over languages, its sharpness fitted on documents kept out
of the counts. A document is rejected if its cross-entropy, drawn to the
language's usual one when it is short, lies by a margin above the ``QUANTILE`` of
those documents.

The models are fitted on a bounded sample of every language's labelled texts: at
most ``SAMPLE_DOCS`` different ones and ``SAMPLE_CHARS`` characters a language, chosen by
a hash, each cut at ``TEXT_CHARS``. Everything else works on all rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
rejected; without any labelled text every document is ``und``; equal entropies go
to the smaller language; one language alone scores 1; repeated rows get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chars, vec
from .common import staged

ORDER = 5
SAMPLE_DOCS, SAMPLE_CHARS, TEXT_CHARS = 600, 1_000_000, 100_000
#: Different texts a language may always have, however many languages there are.
LEAST_DOCS = 60
#: Every so-manieth sampled document is kept out of the counts, for calibration.
HOLD = 5
#: Calibration documents of a language that are not to be rejected, and the margin in nats a character over them; characters by which a short text leans on the usual entropy.
QUANTILE, MARGIN, LEAN = 0.99, 0.75, 60.0
UNKNOWN = "und"
SLICE = 400_000
_POWER = [np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in range(ORDER + 1)]
_BLANK = vec.mix(np.array([32], np.uint64))[0]


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mixed codes with ORDER - 1 blanks before each document, index of each real
    character, its document)."""
    x, off = chars.mapped(data, off, chars.letter_table())
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    at = np.arange(len(x)) + (doc + 1) * (ORDER - 1)
    out = np.full(len(x) + n * (ORDER - 1), _BLANK, np.uint64)
    out[at] = vec.mix(x)
    return out, at, doc


def hash_of(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each index (0 for n = 0); ``x`` holds mixed codes."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h += x[at - j] * _POWER[j]
    return h


class _Counts:
    """Kneser-Ney counts of one language."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        off = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
        x, at, _ = letters(np.frombuffer(b"".join(raw), np.uint8), off)
        self.grams: list[tuple] = [()] * ORDER
        key, first, count = np.unique(hash_of(x, at, ORDER), return_index=True, return_counts=True)
        for n in range(ORDER, 0, -1):
            context, suffix = hash_of(x, at[first] - 1, n - 1), hash_of(x, at[first], n - 1)
            self.grams[n - 1] = (key, count, context, suffix)
            if n > 1:
                key, again, count = np.unique(suffix, return_index=True, return_counts=True)
                first = first[again]
        self.letters = np.unique(x)


class Sorted:
    """Sorted hash array; a table over the leading bits tells where to start, so
    a look-up reads a few neighbouring entries."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        lead = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted hash, or -1."""
        lead = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        out = np.where((self.keys[at] == wanted) & (at < end), at, -1)
        todo = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(todo):
            at[todo] += 1
            hit = self.keys[at[todo]] == wanted[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            todo = todo[at[todo] + 1 < end[todo]]
        return out


class Model:
    """All languages' models, and what calibration found."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        fit = {k: [t for i, t in enumerate(v) if i % HOLD or len(v) < HOLD] for k, v in samples.items()}
        kept = {k: [t for i, t in enumerate(v) if i % HOLD == 0] or v for k, v in samples.items()}
        counts = [_Counts(fit[k]) for k in self.languages]
        size = max(2, len(np.unique(np.concatenate([c.letters for c in counts])))) + 1
        self.keys, self.prob, self.contexts, self.weight = [], [], [], []
        self.floor = np.full(len(counts), 1.0 / size)
        for n in range(1, ORDER + 1):
            self._add_order(n, counts)
        self.log = [np.log(p).astype(np.float32) for p in self.prob]
        del self.prob
        self._calibrate(kept)

    def _add_order(self, n: int, counts: list[_Counts]) -> None:
        keys = np.unique(np.concatenate([c.grams[n - 1][0] for c in counts]))
        contexts = np.unique(np.concatenate([c.grams[n - 1][2] for c in counts]))
        suffix, context = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for c in counts:
            at = np.searchsorted(keys, c.grams[n - 1][0])
            context[at], suffix[at] = c.grams[n - 1][2], c.grams[n - 1][3]
        lower = self.prob[-1][self.keys[-1].find(suffix)] if n > 1 else np.tile(self.floor, (len(keys), 1))
        prob, weight = np.empty((len(keys), len(counts))), np.ones((len(contexts), len(counts)))
        for i, c in enumerate(counts):
            k, m, ctx, _ = c.grams[n - 1]
            one, two = (m == 1).sum(), (m == 2).sum()
            cut = one / (one + 2 * two) if one and two else 0.5
            group = np.searchsorted(contexts, ctx)
            total = np.bincount(group, m, len(contexts))
            kinds = np.bincount(group, minlength=len(contexts))
            seen = total > 0
            weight[seen, i] = cut * kinds[seen] / total[seen]
            own = weight[np.searchsorted(contexts, context), i]
            prob[:, i] = own * lower[:, i]
            at = np.searchsorted(keys, k)
            prob[at, i] += (m - cut) / total[group]
        self.keys.append(Sorted(keys))
        self.prob.append(prob)
        self.contexts.append(Sorted(contexts))
        self.weight.append(np.log(weight).astype(np.float32))

    def logs(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(characters, languages) log probability."""
        i = self.keys[-1].find(hash_of(x, at, ORDER))
        out = self.log[-1][i]
        todo = np.flatnonzero(i < 0)
        out[todo] = 0
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                i = self.keys[n - 1].find(hash_of(x, at[todo], n))
                out[todo[i >= 0]] += self.log[n - 1][i[i >= 0]]
                todo = todo[i < 0]
            i = self.contexts[n - 1].find(hash_of(x, at[todo] - 1, n - 1))
            out[todo[i >= 0]] += self.weight[n - 1][i[i >= 0]]
        out[todo] += np.log(self.floor).astype(np.float32)
        return out

    def entropies(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((documents, languages) nats a character, letters of each document)."""
        x, at, doc = letters(data, off)
        n = len(off) - 1
        count = np.bincount(doc, minlength=n)
        some = np.bincount(doc[x[at] != _BLANK], minlength=n)
        total = np.zeros((n, len(self.languages)))
        if len(at):
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            total[doc[first]] = np.add.reduceat(self.logs(x, at), first, axis=0, dtype=np.float64)
        return -total / np.maximum(count, 1)[:, None], some

    def _calibrate(self, kept: dict[str, list[str]]) -> None:
        h, truth, n = [], [], []
        for i, k in enumerate(self.languages):
            raw = [t.encode() for t in kept[k]]
            off = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
            e, some = self.entropies(np.frombuffer(b"".join(raw), np.uint8), off)
            h.append(e[some > 0])
            truth += [i] * int((some > 0).sum())
            n.append(some[some > 0])
        h, n, truth = np.concatenate(h), np.concatenate(n), np.array(truth, np.int64)
        own = h[np.arange(len(h)), truth]
        self.usual = np.array([np.median(own[truth == i]) if (truth == i).any() else 0.0 for i in range(len(self.languages))])
        lean = (own * n + self.usual[truth] * LEAN) / (n + LEAN)
        self.limit = np.array([np.quantile(lean[truth == i], QUANTILE, method="higher") if (truth == i).any() else 0.0
                               for i in range(len(self.languages))]) + MARGIN
        best = (np.inf, 1.0)
        for sharp in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
            p = posterior(h, n, sharp)
            best = min(best, (-np.log(np.maximum(p[np.arange(len(h)), truth], 1e-12)).mean(), sharp))
        self.sharp = best[1]

    def predict(self, data: np.ndarray, off: np.ndarray):
        """(language index or -1, score, rejected) of each text."""
        h, some = self.entropies(data, off)
        pick = h.argmin(1)
        rows = np.arange(len(h))
        score = np.where(some > 0, posterior(h, some, self.sharp)[rows, pick], 0.0)
        lean = (h[rows, pick] * some + self.usual[pick] * LEAN) / (some + LEAN)
        return np.where(some > 0, pick, -1), score, (some == 0) | (lean > self.limit[pick])


def posterior(h: np.ndarray, n: np.ndarray, sharp: float) -> np.ndarray:
    """Share of each language, from the entropies of the whole text."""
    bits = (h - h.min(1, keepdims=True)) * (n[:, None] * sharp)
    p = np.exp(-np.minimum(bits, 700.0))
    return p / p.sum(1, keepdims=True)


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Training texts of every language with a labelled text that has letters."""
    rows = docs.select("text", "lang").where("lang is not null and text is not null")
    kinds = staged(rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count(), "lang_kinds")
    n = kinds.count()
    each = min(SAMPLE_DOCS, max(LEAST_DOCS, 20 * SAMPLE_DOCS // max(1, n)))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    few = rows.withColumn("d", drawn).join(F.broadcast(kinds), "lang")
    few = few.where(F.col("d") < F.least(F.lit(1.0), 1.3 * each / F.col("count")) * (1 << 30))
    few = few.select("lang", "d", F.substr("text", F.lit(1), F.lit(TEXT_CHARS)).alias("text")).dropDuplicates()
    samples: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for r in sorted(few.collect(), key=lambda r: (r.d, r.text)):
        if len(samples.setdefault(r.lang, [])) < each and used.get(r.lang, 0) + len(r.text) <= SAMPLE_CHARS:
            samples[r.lang].append(r.text)
            used[r.lang] = used.get(r.lang, 0) + len(r.text)
    return {k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)}


def train(docs: DataFrame) -> Model | None:
    """Model from (text, lang) rows; None if there is no labelled text."""
    samples = sample(docs)
    return Model(samples) if samples else None


def identify(docs: DataFrame, model: Model | None, columns: list[str], keep_only: bool = False) -> DataFrame:
    """``columns`` of every document with lang_pred, score and rejected; with
    ``keep_only``, just the columns of those that aren't rejected."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in columns]
    out = fields if keep_only else [*fields, T.StructField("lang_pred", T.StringType()),
                                    T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    at = [f"_{i}" for i in range(len(columns))]

    def run(batches):
        m = told.value
        names = np.array([*(m.languages if m else []), UNKNOWN], object)
        for b in batches:
            for part, data, off in vec.text_slices(b, "_text", SLICE):
                if m is None:
                    pick, score, bad = np.full(len(part), -1), np.zeros(len(part)), np.ones(len(part), bool)
                else:
                    pick, score, bad = m.predict(data, off)
                cols = part.columns[1:]
                if keep_only:
                    mask = pa.array(~bad)
                    yield pa.RecordBatch.from_arrays([c.filter(mask) for c in cols], names=columns)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(names[pick], pa.string()), pa.array(score), pa.array(bad)],
                        names=[f.name for f in out])
    return (docs.select(F.col("text").alias("_text"), *[F.col(c).alias(a) for c, a in zip(columns, at, strict=True)])
            .mapInArrow(run, T.StructType(out)))


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; the models
    see no document of the fold that is held out."""
    out = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return identify(out, train(out.where("not held_out")), ["doc_id", "held_out"])
