"""op5: sets that lack shingles in some chunks meet their partners, and nobody else."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mailweave.llm import parity


def keys_by_text(texts, k, percent):
    """For each text its keys, by band."""
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    out = [set() for _ in texts]
    at = 0
    for part, doc, h, n, _ in parity._sets(batch, k):
        for rows, band, base, words, (owner, key) in parity.sketches(doc, h, n, percent):
            assert (np.diff(owner) >= 0).all() and set(owner) <= set(range(len(rows)))
            for o, x in zip(owner, key, strict=True):
                out[at + rows[o]].add((int(band[o]), int(x)))
        at += len(part)
    return out


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (3, 90)])
def test_sets_without_a_common_shingle_share_no_key(k, percent):
    rng = random.Random(3)
    texts = [" ".join(f"w{i}x{j}" for j in range(rng.randrange(8, 160))) for i in range(600)]
    seen = set()
    for keys in keys_by_text(texts, k, percent):
        assert not keys & seen        # an empty chunk was a key that hundreds of them shared
        seen |= keys


@pytest.mark.parametrize(("k", "percent"), [(1, 80), (2, 80), (1, 90)])
def test_linked_sets_share_a_key(k, percent):
    """Texts of few words, edited until they are just linked: each linked pair of different sets meets."""
    rng = random.Random(percent + k)
    texts = []
    for size in [*range(2, 30), *range(40, 150, 9)]:
        for _ in range(4):
            words = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
            texts.append(" ".join(words))
            for cut in range(1, max(2, size * (100 - percent) // 100 + 1)):
                texts.append(" ".join(words[cut:]))
                texts.append(" ".join(words[:-cut] + [f"v{rng.randrange(10 ** 6)}" for _ in range(cut // 2)]))
    keys = keys_by_text(texts, k, percent)
    sets = [{tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)} for w in (t.split() for t in texts)]
    linked, holds = 0, defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    for a, b in {ab for at in holds.values() for ab in itertools.combinations(at, 2)}:
        both = len(sets[a] & sets[b])
        if both and sets[a] != sets[b] and both * 100 >= percent * len(sets[a] | sets[b]):
            linked += 1
            assert keys[a] & keys[b], (texts[a], texts[b])
    assert linked > 300
