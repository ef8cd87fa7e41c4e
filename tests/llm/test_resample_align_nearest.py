"""Importance resampling, tokenizer alignment and nearest neighbours against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailweave.llm import alignment, graphs, queries, resample

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, rank long, block long, tie long, weight long, pieces string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, "p") for i, t in rows], DOC)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "Ärger, naïve Ääh WORDS words 12 x12! " * 30), (4, "Ärger, naïve Ääh WORDS words 12 x12! " * 30),
        (None, "some words of no number " * 9), (None, None), (7, "one"), (8, "long text goes on and on " * 40_000),
        (9, "a▁b c"), (10, "  two  spaces   <|endoftext|> <s> </s>   nb　wide \n\n end "), (11, "日本語 テスト \U0001F600 " * 50),
        (12, "\x00\x01 a\x85 b  c"), (13, "q" * 30_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- resampling --------------------------------------------------------------------------------------------------
def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams_of(text, longest):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_draw(rows, target, percent, least, buckets, longest, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in rows for g in grams_of(x, longest)), Counter(bucket(g) for x in target for g in grams_of(x, longest))
    sums = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (sums[0] + buckets) / ((s[b] + 1.0) * (sums[1] + buckets)))) for b in range(buckets)}
    out = []
    for i, x in rows:
        g = grams_of(x, longest)
        weight = sum(gain[bucket(f)] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50)])
def test_draw_equals_brute_force(spark, docs, longest, buckets, percent):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = resample.drawn(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), percent, 20, buckets, longest, 7, "t")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_draw(rows, target, percent, 20, buckets, longest, 7)


def test_draw_of_edge_rows(spark, edge):
    target = spark.createDataFrame([(1, "words of no number"), (2, None), (3, "")], "item_id long, text string")
    got = sorted((tuple(r) for r in resample.drawn(edge, target, 50, 5, name="t").collect()), key=repr)
    assert got == brute_draw(EDGE, ["words of no number", None, ""], 50, 5, 10_000, 1, 2024)


def test_draw_without_documents_or_target(spark, edge):
    none = frame(spark, [])
    target = spark.createDataFrame([], "item_id long, text string")
    assert resample.drawn(none, target, name="t").count() == 0
    assert resample.drawn(edge, target, name="t").count() == len(EDGE)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_features_of_a_batch_cut_into_parts(monkeypatch, kind):
    """Texts after the first part of a batch are read from their own bytes."""
    texts = ["Aa bb", None, "É x1, X1", "日本 q" * 9, "", "last WORD"]
    batch = pa.record_batch({"text": pa.array([*texts, "cut off"], kind)}).slice(0, len(texts))
    monkeypatch.setattr(resample, "SLICE_BYTES", 8)
    got = []
    for part, text in resample.texts_of(batch.slice(1)):
        n_words, doc, bucket = resample.features(text, 10_000, 1)
        got += [(int(n), bucket[doc == i].tolist()) for i, n in enumerate(n_words)]
        assert len(part) == len(text)
    assert got == [(len(w), [zlib.crc32(x.encode()) % 10_000 for x in w]) for w in map(words_of, texts[1:])]


def test_draw_in_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = sorted(con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({resample.SQL})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.op11_importance_resampling(spark, SF).collect()), key=repr) == want


# --- alignment ---------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def coders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")


def brute_alignment(rows, coders):
    """Whole texts encoded at once; groups from the ends both share; links by comparing all tokens of a group."""
    a, b = coders
    letters = alignment.byte_alphabet()
    spelled = {i: bytes(letters[c] for c in e) for e, i in a.get_vocab(with_added_tokens=True).items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    done, count = [], Counter()
    for i, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = [b"".join(spelled[t] for t in x), b"".join(piece(t) for t in y)]
        if not text or whole != [(" " + text).encode()] * 2:
            done.append((i, [], [], []))
            continue
        ea, eb = np.cumsum([len(spelled[t]) for t in x]), np.cumsum([len(piece(t)) for t in y])
        shared = np.intersect1d(ea, eb)
        ga, gb = np.searchsorted(shared, ea), np.searchsorted(shared, eb)
        links, fa, fb = [], np.append(0, np.cumsum(np.bincount(ga))), np.append(0, np.cumsum(np.bincount(gb)))
        groups = []
        for g in range(len(shared)):
            groups.append((x[fa[g]:fa[g + 1]], y[fb[g]:fb[g + 1]]))
            for p in range(fa[g], fa[g + 1]):
                for q in range(fb[g], fb[g + 1]):
                    if max(ea[p - 1] if p else 0, eb[q - 1] if q else 0) < min(ea[p], eb[q]):
                        links.append((x[p], y[q]))
        count.update(links)
        done.append((i, x, y, groups, links))
    best = {}
    for (_, q), n in count.items():
        best[q] = max(n, best.get(q, 0))
    out = []
    for i, x, y, groups, *links in done:
        links = links[0] if links else []
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark, docs, coders):
    got = queries.op12_token_alignment(spark, SF).select(COLS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_alignment([(r.doc_id, r.text) for r in docs.collect()], coders)


def test_alignment_of_edge_rows_in_small_blocks(spark, edge, coders, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)   # reaches the tasks with the function's globals, where it is theirs
    got = sorted((tuple(r) for r in alignment.aligned(edge, name="t").select(COLS).collect()), key=repr)
    assert got == brute_alignment(EDGE, coders)
    assert [r[1:] for r in got if r[0] in (1, 2, 9)] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_blocks_agree(coders):
    """One text's digest is the same in whatever block it stands, and every row comes back."""
    blob = [open(f"{alignment.TOKENIZERS}/{f}", "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    a, b = alignment.coder("byte", blob[0]), alignment.coder("piece", blob[1])
    texts = [t or "" for _, t in EDGE if t is None or len(t) < 5000]
    whole = [r for x in alignment.encoded_block(0, pa.array(range(len(texts)), pa.int64()), pa.array(texts), a, b) for r in x.to_pylist()]
    for k, t in enumerate(texts):
        alone = next(alignment.encoded_block(0, pa.array([k], pa.int64()), pa.array([t]), a, b)).to_pylist()[0]
        assert {c: alone[c] for c in alignment.TEXT} == {c: whole[k][c] for c in alignment.TEXT}


def test_diagonal_equals_shared_ends():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 4000):
        for share in (0.02, 0.5, 0.98):
            ends = np.arange(1, n + 1)
            both = rng.random(n) < share
            a, b = (np.append(ends[:-1][(both | (rng.random(n) < 0.4))[:-1]], n) for _ in range(2))
            ga, gb, la, lb = alignment.diagonal(a.tolist(), b.tolist())
            assert np.array_equal(a[ga], np.intersect1d(a, b)) and np.array_equal(b[gb], np.intersect1d(a, b))
            step = np.union1d(a, b)   # each overlap is one stretch between neighbouring ends
            assert np.array_equal(la, np.searchsorted(a, step)) and np.array_equal(lb, np.searchsorted(b, step))


def test_no_documents_to_align(spark):
    assert alignment.aligned(frame(spark, []), name="t").count() == 0


# --- nearest neighbours ------------------------------------------------------------------------------------------
VEC = "vec_id long, embedding array<float>, label int, dim int, shard int, v string, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "v", "i") for i, v in rows], VEC)


def brute_nearest(rows, every, k):
    """[(query_id, rank, vec_id, score)] over usable vectors, the least vector of an id."""
    own = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            v = [float(np.float32(c)) for c in v]
            own[i] = min(own.get(i, v), v)
    out = []
    for i, v in own.items():
        if i % every == 0:
            got = sorted(((-float((np.array(v) * np.array(w)).sum()), j) for j, w in own.items() if j != i and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got)]
    return out


def recall(got, want):
    have = {(q, j) for q, _, j, _ in got}
    return sum((q, j) in have for q, _, j, _ in want) / len(want)


def test_query_recall_and_order(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.op13_nearest_neighbours(spark, SF).collect()]
    want = brute_nearest(rows, 20, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.99
    own = dict(rows)
    for q in {r[0] for r in got}:
        mine = sorted((r for r in got if r[0] == q), key=lambda r: r[1])
        assert [r[1] for r in mine] == list(range(1, 21)) and [(-r[3], r[2]) for r in mine] == sorted((-r[3], r[2]) for r in mine)
        for _, _, j, s in mine:
            assert j != q and s == pytest.approx(float(np.dot(np.array(own[q], float), np.array(own[j], float))), abs=1e-12)


@pytest.mark.parametrize("shard_rows", [400, 3000])
def test_recall_over_shards_with_a_hot_cluster_and_unequal_norms(spark, shard_rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))
    x[:1000] = x[0] + rng.normal(size=(1000, 24)) * 0.01     # near copies
    x[1000:1400] = x[1000]                                  # exact ones
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got = [tuple(r) for r in graphs.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20, shard_rows, name="t").collect()]
    want = brute_nearest(rows, 20, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.97


def test_copies_win_by_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(i, [0.5, 1.0, 1.5]) for i in range(100, 120)]
    got = sorted(tuple(r) for r in graphs.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20, name="t").collect())
    assert got == sorted(brute_nearest(rows, 20, 20))


def test_edge_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.9, 0.5]), (40, None), (60, []), (80, [0.0, 0.0]),
            (100, [float("nan"), 1.0]), (120, [None, 1.0]), (140, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [-1.0, 0.5]),
            (2, [1e30, 1e30]), (160, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 4.0]), (180, [7.0])]
    got = sorted(tuple(r) for r in graphs.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20, name="t").collect())
    assert got == sorted(brute_nearest(rows, 20, 20))
    assert graphs.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0, name="t").count() == 0


def test_every_vector_is_indexed(spark):
    rows = vectors(spark, [(i, [float(np.cos(i)), float(np.sin(i)), 1.0]) for i in range(1000)])
    got = graphs.index(graphs.usable(rows), shard_rows=150, name="t").select("ids", "sizes", "neighbours").collect()
    assert sorted(i for r in got for i in r.ids) == list(range(1000)) and len(got) == 7
    for r in got:
        low = np.frombuffer(r.neighbours[0], np.int32).reshape(r.sizes[0], -1)
        seen, todo = {0}, [0]
        while todo:
            todo = [int(j) for i in todo for j in low[i] if j >= 0 and int(j) not in seen and not seen.add(int(j))]
        assert len(seen) == r.sizes[0]
