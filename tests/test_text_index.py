"""The maintained text index (D1-D6, K5): change sets and merges against fresh builds, blocks, bounds, pruning."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailweave.operators import index as IX
from mailweave.session import folders
from test_mended import messages


def rows_of(ix):
    return sorted((r["term"], r["field"], r["message_id"], r["tf"], tuple(r["positions"]), r["dl"], r["live"]) for r in ix.postings.collect())


def corpus(n, seed=1, words=60):
    """Messages whose words follow a skewed law: ``w0`` stands in nearly all of them."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(words)], weights, k=rng.randrange(3, 60)))
    return [dict(message_id=f"m{i}", subject=f"s{i % 7}", body=text(), is_deleted=i % 11 == 0) for i in range(n)]


def stats_of(ix):
    return {f: s for f, s in ix.stats.items()}


def frequencies(ix):
    return sorted((r["term"], r["field"], r["df"], r["df_live"]) for r in ix.frequencies.collect())


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index grown by new, repeated, changed, removed, deleted and restored messages, and one built afresh."""
    at = tmp_path_factory.mktemp("ix")
    rows = corpus(240)
    for r in rows:
        r["is_deleted"] = False
    IX.store_index(messages(spark, *rows[:100]), str(at / "a"), buckets=8, block_rows=16)
    IX.extend(spark, str(at / "a"), messages(spark, *rows[90:150]), 1)
    changed = [{**r, "body": "all new words " + r["body"][:20]} for r in rows[20:40]]
    ids = lambda rs: spark.createDataFrame([(r["message_id"],) for r in rs] or [("none",)], "message_id string")
    IX.replace(spark, str(at / "a"), messages(spark, *changed, *rows[150:200]), 2, removed=ids(rows[60:70]))
    IX.flag(spark, str(at / "a"), ids(rows[:30]), False, 3)
    IX.flag(spark, str(at / "a"), ids(rows[5:10]), True, 4)
    IX.extend(spark, str(at / "a"), messages(spark, *rows[120:240]), 5)
    final = {r["message_id"]: r for r in rows}
    final.update({r["message_id"]: r for r in changed})
    for r in rows[60:70]:
        del final[r["message_id"]]
    final = [{**r, "is_deleted": i in {f"m{k}" for k in range(30)} - {f"m{k}" for k in range(5, 10)}} for i, r in final.items()]
    fresh = IX.store_index(messages(spark, *final), str(at / "b"), buckets=8, block_rows=16)
    return str(at / "a"), fresh, final


def test_change_sets_equal_a_fresh_build(spark, grown):
    ix, (_, fresh, _) = IX.load_index(spark, grown[0]), grown
    assert len(ix.deltas) == 5 and rows_of(ix) == rows_of(fresh)
    assert stats_of(ix) == stats_of(fresh) and frequencies(ix) == frequencies(fresh)


def brute_bm25(final, words, k, k1=1.2, b=0.75):
    docs = {r["message_id"]: Counter(r["body"].split()) for r in final if not r["is_deleted"] and r["body"]}
    avg = sum(d.total() for d in docs.values()) / len(docs)
    out = {}
    for w in words:
        df = sum(w in d for d in docs.values())
        for i, d in docs.items():
            if w in d:
                out[i] = out.get(i, 0) + math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * d[w] * (k1 + 1) / (d[w] + k1 * (1 - b + b * d.total() / avg))
    return sorted(((i, round(s, 9)) for i, s in out.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("state", ["grown", "fresh", "merged"])
@pytest.mark.parametrize("words", [["w0"], ["w0", "w3", "w41"], ["w1", "new"], ["absent"]])
def test_bm25_equals_brute_force(spark, grown, state, words, tmp_path):
    path, fresh, final = grown
    ix = {"grown": lambda: IX.load_index(spark, path), "fresh": lambda: fresh, "merged": lambda: merged(spark, grown)}[state]()
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    for k1, b in ((1.2, 0.75), (2.0, 0.3)):
        got = [(r["message_id"], r["score"]) for r in IX.bm25(ix, terms, "body", 7, k1, b).collect()]
        want = brute_bm25(final, words, 7, k1, b)
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-9)


_MERGED = {}


def merged(spark, grown):
    """The grown index merged once, in a copy made by Spark."""
    path = grown[0]
    if path not in _MERGED:
        import shutil
        shutil.copytree(path, path + "-merged")
        _MERGED[path] = IX.merge(spark, path + "-merged")
    return _MERGED[path]


def test_merge_keeps_everything(spark, grown):
    _, fresh, _ = grown
    ix = merged(spark, grown)
    assert ix.deltas == [] and rows_of(ix) == rows_of(fresh) and stats_of(ix) == stats_of(fresh) and frequencies(ix) == frequencies(fresh)
    IX.extend(spark, ix.path, messages(spark, dict(message_id="later", body="w0 later", subject="x")), 6)
    again = IX.merge(spark, ix.path)
    assert [r[2] for r in rows_of(again) if r[0] == "later"] == ["later"] and len(rows_of(again)) == len(rows_of(fresh)) + 6


def test_merge_leaves_untouched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "ix")
    IX.store_index(messages(spark, *corpus(60)), path, buckets=32)
    IX.extend(spark, path, messages(spark, dict(message_id="n1", subject="", body="zebra", sender=None)), 1)
    ix = IX.merge(spark, path)
    assert set(ix.of["postings"]) == {0, 2} and len(ix.of["postings"][2]) == 1 and len(ix.of["docs"][2]) == 1
    assert len(folders(spark, f"{path}/postings/gen=2")) <= 3      # one bucket beside Spark's own files
    assert [r["message_id"] for r in IX.match_any(ix, spark.createDataFrame([("zebra",)], "term string")).collect()] == ["n1"]


def test_change_sets_are_written_once(spark, tmp_path):
    path = str(tmp_path / "ix")
    IX.store_index(messages(spark, dict(message_id="a", body="one")), path, buckets=4)
    for text in ("two", "never"):
        IX.extend(spark, path, messages(spark, dict(message_id="b", body=text)), 1)      # the second is a replay
    assert sorted(t for t, f, i, *_ in rows_of(IX.load_index(spark, path)) if f == "body") == ["one", "two"]
    IX.merge(spark, path)
    IX.extend(spark, path, messages(spark, dict(message_id="c", body="late replay")), 1)
    assert IX.indexed(spark, path, 1) and not IX.indexed(spark, path, 2) and len(IX.load_index(spark, path).deltas) == 0


def test_frequent_terms_spread_over_even_tasks(spark, tmp_path):
    """One term in every message: no file holds it whole, and files are even."""
    rows = [dict(message_id=f"m{i}", subject=None, body=f"common word{i % 50} rare{i}", sender=None) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # else these few rows are one task's
    try:
        ix = IX.store_index(messages(spark, *rows), str(tmp_path / "ix"), buckets=4, block_rows=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    p = ix.stored("postings")
    blocks = p.filter("term = 'common'").groupBy("block").count().collect()
    assert len(blocks) == 64 and max(r["count"] for r in blocks) < 200
    writes = p.select(F.regexp_extract(F.col("_metadata.file_name"), "part-(\\d+)", 1).alias("task"), "term").groupBy("task").agg(
        F.count("*").alias("n"), F.count_if(F.col("term") == "common").alias("hot")).collect()
    n = sorted(r["n"] for r in writes)
    assert n[-1] < 3 * n[len(n) // 2] and max(r["hot"] for r in writes) < 3000


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path):
    rows = [dict(message_id=f"m{i}", subject=None, sender=None, body=("gold " * 9 if i in (17, 401, 1333) else "gold ") + "lead " * (i % 40 + 5))
            for i in range(2000)]
    ix = IX.store_index(messages(spark, *rows), str(tmp_path / "ix"), buckets=4, block_rows=20)
    for words in (["gold"], ["gold", "lead"]):
        rank, postings = IX.ranked_postings(ix, words, "body", 3)
        whole = rank.postings()
        assert postings.count() < whole.count() / 2
        top = lambda p: [tuple(r) for r in rank.scores(p).orderBy(F.col("score").desc(), "message_id").limit(3).collect()]
        assert top(postings) == top(whole) and {r[0] for r in top(whole)} == {"m17", "m401", "m1333"}
    assert "block" in postings._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_prefix_reads_its_terms_buckets(spark, grown):
    plan = IX.match_prefix(grown[1], "W1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,w1)" in plan.replace(" ", "") and "dynamicpruning" in plan.lower()
    want = {r["message_id"] for r in grown[2] if any(w.startswith("w1") for w in r["body"].split())}
    assert {r["message_id"] for r in IX.match_prefix(grown[1], "W1").collect()} == want
    assert {r["message_id"] for r in IX.match_prefix(IX.load_index(spark, grown[0]), "w1").collect()} == want


def test_postings_are_made_without_a_shuffle(spark):
    df = messages(spark, dict(message_id="a", subject="b a b", body="", sender={"name": None, "email": "x@y.z"}, recipients=None),
                  dict(message_id="b", subject=None, body=None, sender=None))
    p = IX.build_index(df)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    got = defaultdict(dict)
    for r in p.collect():
        got[r["field"]][r["term"]] = (r["message_id"], r["tf"], r["positions"])
    assert got == {"subject": {"a": ("a", 1, [1]), "b": ("a", 2, [0, 2])}, "sender_email": {"x": ("a", 1, [0]), "y": ("a", 1, [1]), "z": ("a", 1, [2])}}


def test_empty_archive(spark, tmp_path):
    ix = IX.store_index(messages(spark, dict(message_id="a")).limit(0), str(tmp_path / "ix"), buckets=4)
    terms = spark.createDataFrame([("a",)], "term string")
    assert IX.bm25(ix, terms).count() == 0 and IX.match_any(ix, terms).count() == 0 and ix.frequencies.count() == 0
    IX.extend(spark, ix.path, messages(spark, dict(message_id="a", body="a")), 1)
    assert [r["message_id"] for r in IX.bm25(IX.load_index(spark, ix.path), terms).collect()] == ["a"]


# ------------------------------------------------------------------ the kernels
def test_runs_of_parts_equal_plain_counting(monkeypatch):
    """Words, places and nulls, whatever part of a batch a text is in."""
    import pyarrow as pa
    from mailweave.functions import runs as R
    texts = ["b a b", None, "", " ", " 日本 é a é ", "x" * 50, "a"]
    batch = pa.record_batch({"k": pa.array(range(len(texts) + 1)), "t": pa.array(["cut off", *texts])}).slice(1)
    monkeypatch.setattr(R, "SLICE_BYTES", 10)
    got = []
    for part, text in R.text_parts(batch, 1):
        dl, runs = R.runs_of(text)
        assert len(part) == len(dl) == len(runs)
        got += zip(part.column(0).to_pylist(), dl.to_pylist(), runs.to_pylist(), strict=True)
    for (k, n, found), (i, t) in zip(got, enumerate(texts), strict=True):
        words = (t or "").split()
        assert (k, n) == (i + 1, len(words))
        assert found == ([{"term": w, "positions": [p for p, x in enumerate(words) if x == w]} for w in sorted(set(words))] or None)
