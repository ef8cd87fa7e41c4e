"""License scans by a trained paragraph classifier.

A sparse logistic regression over hashed word 1-, 2- and 3-grams tells the licence
family of a passage, or none. It is trained here: on the families' notices below,
varied by rule (words dropped, replaced, cut off at the ends, set in prose), against
a bounded sample of the corpus's own paragraphs and of sentences about licences
that grant none. A temperature and the least probability of a family are
calibrated on passages kept out of the training.

Every line of every text is scored, long ones in overlapping windows of ``WINDOW``
words, and so is every paragraph of several lines (up to a blank line, without words that
are comment marks only), for notices that are wrapped. Of overlapping passages of one
family the first found stays, lines before paragraphs; so does the likest of families with
similar notices, and an unknown one if none overlaps it. A passage that is more likely licence than not is given the likely family whose
notices it resembles most; it is confirmed if it contains enough of the word
3-grams of its name or notice and its probability of a licence passes the calibrated least; one that shows a trace of a notice or speaks of a licence, but isn't confirmed, is
``unknown``.

Defined cases: null and empty texts, and texts without licence passages, have
licence null and an empty list; a document with several families carries that of
its most probable passage (ties: the earlier one); repeated rows get equal
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

WINDOW, STRIDE = 48, 24
BITS = 20
#: Corpus paragraphs drawn as negatives, at most, and their longest length in characters.
NEGATIVES, NEGATIVE_CHARS = 1500, 2000
VARIANTS, ROUNDS, PENALTY = 48, 60, 1e-4
#: Share of the 3-grams of a licence's name or notice that confirms its family, and the least share of an unknown licence.
CONFIRM, TRACE = 0.5, 0.1
#: Families of at least this share of the likeliest one's probability are compared with the passage too.
RIVAL = 0.05
UNKNOWN = "unknown"

#: Names by family (fixed values).
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause license"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 4.0 license"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 4.0 license"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 4.0 license"),
    "CC0-1.0": ("Creative Commons Zero v1.0 Universal dedication", "CC0 1.0 public domain dedication"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0 license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0 license"),
    "ISC": ("ISC License",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0 license"),
    "MIT": ("MIT License", "Expat (MIT) License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0 license"),
    "Proprietary": ("All rights reserved",),
}
GRANTS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.",
          "Distributed under the terms of the {}.", "This software is made available under the {}.",
          "SPDX-License-Identifier: {}")
#: Families whose names are statements of their own.
PLAIN = ("Proprietary",)
#: Opening words of the licences' own notices (fixed values).
NOTICES = {
    "Apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission",),
    "GPL-2.0": ("it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
                "version 2 of the License, or (at your option) any later version",),
    "GPL-3.0": ("it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
                "version 3 of the License, or (at your option) any later version",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file",),
}
#: Sentences about licences that grant none; they train the class without licence.
TALK = ("Please read the license before you use this software.", "A driving license is required for this job.",
        "The license plate was found under the car.", "We released the version on Monday under a new name.",
        "The public was free to use the software at the university.", "All seats were reserved for the rights group.",
        "Terms and conditions apply to every copy that is distributed.", "He works for the Apache foundation in version control.")

FAMILIES = tuple(sorted(NAMES))


def notices() -> list[tuple[str, str]]:
    """(family, text) of every notice."""
    out = [(k, g.format(n)) for k in FAMILIES for n in NAMES[k] for g in (("{}.",) if k in PLAIN else GRANTS)]
    return out + [(k, t) for k in FAMILIES for t in NOTICES.get(k, ())]


_EDGE = np.zeros(256, bool)
_EDGE[list(b"\"'()[]{}<>.,;:!?*_|#%$&")] = True


def word_hashes(data: np.ndarray, off: np.ndarray):
    """(document, start, end, hash) of the words, ASCII letters lower-cased, up to two marks at either edge left out."""
    doc, start, end = vec.words(data, off)
    a, z = start.copy(), end.copy()
    for _ in range(3):
        z -= (z > a) & _EDGE[data[np.maximum(z - 1, 0)]]
    for _ in range(2):
        a += (z > a) & _EDGE[data[np.minimum(a, len(data) - 1)]] if len(data) else 0
    return doc, start, end, vec.span_hash(vec.prefix_hash(data, True), a, z)


_MARK = np.zeros(256, bool)
_MARK[list(b"*/#;-%!<>|=~\"'")] = True


def windows(data: np.ndarray, off: np.ndarray, paragraphs: bool = False):
    """(word hashes, windows as (document, first word, word after, first byte, last
    byte)) of all lines, or those of all paragraphs that reach over a line's end."""
    doc, start, end, h = word_hashes(data, off)
    if paragraphs and len(h):
        marks = np.append(0, np.cumsum(_MARK[data]))
        use = marks[end] - marks[start] < end - start
        doc, start, end, h = doc[use], start[use], end[use], h[use]
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return h, (z, z, z, z, z)
    line = np.append(0, np.cumsum(data == 10))[start]
    new = np.append(True, (doc[1:] != doc[:-1]) | (np.diff(line) > int(paragraphs)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    count = np.maximum(1, -(-(last - first - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(first)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    a = first[owner] + step * STRIDE
    z = np.minimum(a + WINDOW, last[owner])
    if paragraphs:
        over = line[a] != line[z - 1]
        a, z = a[over], z[over]
    return h, (doc[a], a, z, start[a], end[z - 1])


def features(h: np.ndarray, a: np.ndarray, z: np.ndarray):
    """(window, feature) of the 1-, 2- and 3-grams inside each window."""
    rows, feats = [], []
    grams = [h]
    for k in (1, 2):
        if len(h) > k:
            grams.append(vec.mix(grams[-1][:-1] * vec._COEF[k] + h[k:]))
    shift = np.uint64(64 - BITS)
    for k, g in enumerate(grams):
        n = np.maximum(z - a - k, 0)
        row = np.repeat(np.arange(len(a)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[row]
        rows.append(row)
        feats.append((g[at] >> shift).astype(np.int64))
    return np.concatenate(rows), np.concatenate(feats)


def _encode(texts: list[str]):
    """Window features of short texts taken whole."""
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    doc, _, _, h = word_hashes(np.frombuffer(b"".join(raw), np.uint8), off)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return features(h, cuts[:-1], cuts[1:])


class Model:
    """Weights (features x classes; the last class is none), bias, temperature and least probability."""

    def __init__(self, negatives: list[str], seed: int = 7):
        self.templates = {k: [_grams(t) for t in (*NAMES[k], *NOTICES.get(k, ()))] for k in FAMILIES}
        every = [g for v in self.templates.values() for g in v]
        self.alike = {(a, b) for a in FAMILIES for b in FAMILIES if a != b for t in (*NAMES[a], *NOTICES.get(a, ()))
                      if max(contained(g, _runs(t)) for g in self.templates[b]) >= CONFIRM}
        negatives = [t for t in negatives if max((contained(g, _runs(t)) for g in every), default=0.0) < 0.3]
        rng = np.random.default_rng(seed)
        prose = [w for t in negatives[:500] for w in t.split()][:20000] or ["text"]
        texts, labels = [], []
        for i, k in enumerate(FAMILIES):
            own = [t for f, t in notices() if f == k]
            for j in range(VARIANTS):
                texts.append(_vary(own[j % len(own)], prose, rng, j))
                labels.append(i)
        none = len(FAMILIES)
        for t in [*negatives, *TALK * 8]:
            texts.append(" ".join(t.split()[:WINDOW]))
            labels.append(none)
        labels = np.array(labels)
        held = rng.random(len(texts)) < 0.2
        train, test = np.flatnonzero(~held), np.flatnonzero(held)
        self._fit([texts[i] for i in train], labels[train])
        self._calibrate([texts[i] for i in test], labels[test])

    def _fit(self, texts: list[str], labels: np.ndarray) -> None:
        row, feat = _encode(texts)
        order = np.argsort(feat, kind="stable")
        row, feat = row[order], feat[order]
        first = np.flatnonzero(np.append(True, feat[1:] != feat[:-1]))
        used = feat[first]
        column = np.repeat(np.arange(len(used)), np.diff(np.append(first, len(feat))))
        by_row = np.argsort(row, kind="stable")
        starts = np.searchsorted(row[by_row], np.arange(len(texts)))
        c = len(FAMILIES) + 1
        w, b = np.zeros((len(used), c)), np.zeros(c)
        gw, gb = np.full((len(used), c), 1e-8), np.full(c, 1e-8)
        truth = np.eye(c)[labels]
        share = 1.0 / np.maximum(np.bincount(labels, minlength=c), 1)[labels][:, None] / c
        for _ in range(ROUNDS):
            z = np.add.reduceat(w[column[by_row]], starts, axis=0) + b
            p = np.exp(z - z.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - truth) * share
            g = np.add.reduceat(err[row], first, axis=0) + PENALTY * w
            gw += g * g
            w -= 0.5 * g / np.sqrt(gw)
            g = err.sum(0)
            gb += g * g
            b -= 0.5 * g / np.sqrt(gb)
        self.weights = w.astype(np.float32)
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.bias, self.heat = b, 1.0

    def _calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        row, feat = _encode(texts)
        z = self._logits(len(texts), row, feat)
        best = (np.inf, 1.0)
        for heat in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
            p = _softmax(z / heat)
            best = min(best, (-np.log(np.maximum(p[np.arange(len(z)), labels], 1e-9)).mean(), heat))
        self.heat = best[1]
        p = _softmax(z / self.heat)
        pick = p.argmax(1)
        wrong = 1 - p[labels == len(FAMILIES), -1]
        self.least = float(min(0.9, max(0.3, wrong.max() if len(wrong) else 0.3)))
        self.accuracy = float((pick == labels).mean())

    def _logits(self, n: int, row: np.ndarray, feat: np.ndarray) -> np.ndarray:
        feat = self.place[feat]
        row, feat = row[feat >= 0], feat[feat >= 0]
        order = np.argsort(row, kind="stable")
        row, feat = row[order], feat[order]
        z = np.tile(self.bias, (n, 1))
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            z[row[first]] += np.add.reduceat(self.weights[feat], first, axis=0, dtype=np.float64)
        return z

    def _passages(self, data: np.ndarray, off: np.ndarray, paragraphs: bool) -> list[tuple]:
        """(document, passage) of the lines or of the paragraphs."""
        h, (doc, a, z, lo, hi) = windows(data, off, paragraphs)
        out: list[tuple] = []
        if not len(a):
            return out
        p = _softmax(self._logits(len(a), *features(h, a, z)) / self.heat)
        for i in np.flatnonzero(p[:, -1] < 0.5):
            own = _runs(data[lo[i]:hi[i]].tobytes().decode("utf-8", "replace"))
            like, chance, k = max((max(contained(g, own) for g in self.templates[FAMILIES[k]]), p[i, k], -k)
                                  for k in np.flatnonzero(p[i, :-1] >= RIVAL * p[i, :-1].max()))
            if like < TRACE and not any(w[0].startswith("licen") for w in own[0]):
                continue
            sure = 1 - p[i, -1] >= self.least and like >= CONFIRM
            out.append((int(doc[i]), (FAMILIES[-k] if sure else UNKNOWN, float(chance), float(like), int(lo[i]), int(hi[i]))))
        return out

    def scan(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple]]:
        """[(family, probability, likeness, first byte, last byte), ...] of each text."""
        out: list[list[tuple]] = [[] for _ in range(len(off) - 1)]
        for d, x in self._passages(data, off, False):
            out[d].append(x)
        meets = lambda x, y: x[3] < y[4] and y[3] < x[4]
        for d, x in sorted(self._passages(data, off, True), key=lambda r: (r[0], r[1][0] == UNKNOWN, -r[1][2], r[1][3])):
            if any(meets(x, y) and (x[0] in (y[0], UNKNOWN) or ((y[0], x[0]) in self.alike and x[2] < y[2])) for y in out[d]):
                continue
            less = lambda y: meets(x, y) and (y[0] == UNKNOWN or ((x[0], y[0]) in self.alike and y[2] < x[2]))  # noqa: B023, E731
            out[d] = sorted([*(y for y in out[d] if not less(y)), x], key=lambda y: y[3:])
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _words(text: str) -> list[str]:
    found = re.findall(r"[0-9a-z.+\-]+", text.lower())
    return [w for w in (x.strip(".-") for x in found) if w]


def _grams(text: str, k: int = 3) -> frozenset:
    """Runs of k words; of a shorter text its whole sequence."""
    w = _words(text)
    k = min(k, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def contained(small: frozenset, big: tuple[frozenset, ...]) -> float:
    """Share of the runs of ``small`` that ``big`` (runs of 1, 2 and 3 words) holds."""
    return sum(len(g) <= len(big) and g in big[len(g) - 1] for g in small) / max(1, len(small))


def _runs(text: str) -> tuple[frozenset, ...]:
    return tuple(_grams(text, k) for k in (1, 2, 3))


def _vary(text: str, prose: list[str], rng, j: int) -> str:
    """A notice as it may be found: whole at first, later with words dropped or
    replaced, ends cut off, in upper or lower case, with prose around it."""
    w = text.split()
    if j % 4 == 1:
        w = [x for x in w if rng.random() > 0.1] or w
    if j % 4 == 2:
        w = [x if rng.random() > 0.1 else prose[rng.integers(len(prose))] for x in w]
    if j % 3 == 1:
        around = [prose[rng.integers(len(prose))] for _ in range(int(rng.integers(2, 24)))]
        at = int(rng.integers(len(around)))
        w = around[:at] + w + around[at:]
    text = " ".join(w[:WINDOW])
    return text.upper() if j % 7 == 3 else text.lower() if j % 7 == 5 else text


def train(docs: DataFrame) -> Model:
    """Model with negatives from a bounded sample of the corpus's lines."""
    line = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(
        F.length("line").between(20, NEGATIVE_CHARS))
    share = min(1.0, 1.2 * NEGATIVES / max(1, line.count()))
    drawn = F.pmod(F.xxhash64("line"), F.lit(1 << 30))
    rows = line.where(drawn < int(share * (1 << 30)) + 1).distinct().withColumn("d", drawn).collect()
    return Model([r.line for r in sorted(rows, key=lambda r: (r.d, r.line))[:NEGATIVES]])


SCHEMA = ("doc_id long, license string, licenses array<string>, n_passages long, score double, likeness double, "
          "passages array<struct<license:string,score:double,likeness:double,first_byte:long,last_byte:long>>")
_PASSAGE = pa.struct([("license", pa.string()), ("score", pa.float64()), ("likeness", pa.float64()),
                      ("first_byte", pa.int64()), ("last_byte", pa.int64())])


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """SCHEMA rows of every document."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        for b in batches:
            for part, data, off in vec.text_slices(b, limit=400_000):
                found = m.scan(data, off)
                best = [max(f, key=lambda x: (x[0] != UNKNOWN, x[1], -x[3])) if f else None for f in found]
                names = [f.name for f in _PASSAGE]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x and x[0] for x in best], pa.string()),
                     pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())),
                     pa.array([len(f) for f in found], pa.int64()), pa.array([x and x[1] for x in best], pa.float64()),
                     pa.array([x and x[2] for x in best], pa.float64()),
                     pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], pa.list_(_PASSAGE))],
                    names=["doc_id", "license", "licenses", "n_passages", "score", "likeness", "passages"])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
