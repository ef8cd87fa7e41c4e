"""Packed postings: few rows, none of them shuffled apart; marks of any size; the phrase that most messages hold."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailweave.operators import index as IX, store as ST
from test_mended import messages
from test_text_index import corpus, frequencies, grown, rows_of, stats_of  # noqa: F401


def test_a_slice_packs_a_terms_postings(spark, tmp_path):
    """A row holds the postings of a term in one block, as far as they lie in one slice of messages."""
    ix = IX.store_index(messages(spark, *corpus(400)), str(tmp_path / "ix"), buckets=4, block_rows=50)
    packed, postings = ix.packed(), ix.stored("postings")
    assert packed.count() < postings.count() / 3
    assert packed.filter("n <> size(hits) OR n_live <> size(filter(hits, h -> h.live))").isEmpty()
    low, width = F.expr("block * shiftleft(1, 30 - bits)"), F.expr("shiftleft(1, 30 - bits)")
    at = packed.select(low.alias("low"), width.alias("width"), F.explode("hits.message_id").alias("id")).withColumn("at", IX.hash_of("id"))
    assert at.filter("at < low OR at >= low + width").isEmpty()          # every posting lies in its block's range
    top = postings.join(packed.select("term", "field", F.size("hits").alias("n")).groupBy("term", "field").agg(F.sum("n").alias("n")), ["term", "field"])
    assert top.groupBy("term", "field").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter("c <> n").isEmpty()
    avg = F.when(F.col("field") == "body", ix.stats["body"]["total"] / ix.stats["body"]["n"])
    best = postings.filter("field = 'body'").groupBy("term", "block").agg(F.max(IX.impact(F.col("tf"), F.col("dl"), avg)).alias("best"))
    bound = ix.stored("terms").filter("field = 'body'").groupBy("term", "block").agg(F.max("top").alias("top"))
    assert best.join(bound, ["term", "block"]).filter("best > top + 1e-9").isEmpty()


def test_marks_of_any_size(spark, grown, tmp_path, monkeypatch):  # noqa: F811
    """Marks too many to be broadcast go by the bitmap; postings, counts and a merge are the same."""
    import shutil
    path, fresh, _ = grown
    shutil.copytree(path, str(tmp_path / "ix"))
    monkeypatch.setattr(IX, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ST, "BROADCAST_BYTES", 0)
    ix = IX.load_index(spark, str(tmp_path / "ix"))
    assert rows_of(ix) == rows_of(fresh) and frequencies(ix) == frequencies(fresh)
    ix = IX.merge(spark, ix.path)
    assert rows_of(ix) == rows_of(fresh) and frequencies(ix) == frequencies(fresh) and stats_of(ix) == stats_of(fresh)


@pytest.mark.parametrize("most", [1000, 2])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_top_phrase_equals_plain_counting(spark, monkeypatch, n, most):
    monkeypatch.setattr(IX, "PUSHED_BLOCKS", most)
    rng = random.Random(n)
    texts = [" ".join(rng.choices("a b c é".split(), k=rng.randrange(0, 9))) for _ in range(60)] + [None, "", " b  A ", "x y z", "x y z"]
    for some in (texts, texts[-5:], ["p q r", "s t u"], ["one"], [None]):
        df = messages(spark, *[dict(message_id=f"m{i}", body=t) for i, t in enumerate(some)])
        count = Counter(g for t in some for g in {tuple(w[i:i + n]) for w in [(t or "").lower().split()] for i in range(len(w) - n + 1)})
        want = min(count, key=lambda g: (-count[g], g), default=())
        assert tuple(r["term"] for r in IX.top_phrase(df, n).orderBy("i").collect()) == want
