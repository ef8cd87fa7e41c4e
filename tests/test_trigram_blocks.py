"""The trigram index holds a row per run and block of messages, not one per run and message."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailweave.functions import runs as R
from mailweave.operators import search as S, substrings as SUB
from test_mended import messages


def held(texts):
    """(run, number of the text) pairs by the kernel."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
    out = []
    for part, text in R.text_parts(batch, 1):
        grams, ends, places = R.trigrams_of(text)
        assert grams == sorted(set(grams)) and len(ends) == len(grams) + 1
        for k, g in enumerate(grams):
            assert (np.diff(places[ends[k]:ends[k + 1]]) > 0).all()
            out += [(g, part.column(0)[int(p)].as_py()) for p in places[ends[k]:ends[k + 1]]]
    assert len(out) == len(set(out))
    return set(out)


EVERY = "".join(map(chr, [*range(1, 0xd800), *range(0xe000, 0x110000)]))


@pytest.mark.parametrize("slice_bytes", [10, 300, 4_000_000])
def test_runs_of_three_equal_a_plain_loop(slice_bytes, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", slice_bytes)
    rnd = random.Random(slice_bytes)
    cases = [[], [None], [""], ["ab"], ["abc"], ["ab", "cd"], [None, "abcabc", "", "a\0\0\0b", "日本語テスト😀😀😀x", "ü", "é😀z", "abc"]]
    for size in (2, 30, 3000):
        some = rnd.sample(EVERY, size)
        cases.append([None if rnd.random() < .1 else "".join(rnd.choices(some, k=rnd.choice([0, 1, 2, 3, 9, 60]))) for _ in range(100)])
    for texts in cases:
        assert held(texts) == {(t[i:i + 3], k) for k, t in enumerate(texts) if t for i in range(len(t) - 2)}


def test_runs_of_three_of_every_character():
    texts = [EVERY[i:i + 200] for i in range(0, len(EVERY), 200)] + ["abc"]
    assert held(texts) == {(t[i:i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}


def test_a_run_takes_a_row_a_block_and_blocks_are_cut(spark, tmp_path):
    n, batch = SUB.BLOCK_ROWS + 1_000, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    row = messages(spark, dict(message_id="m"))
    i = F.col("id")
    df = spark.range(0, n, 1, 1).crossJoin(F.broadcast(row)).withColumns({
        "message_id": F.concat(F.lit("m"), i), "subject": F.when(i % 11 > 0, F.concat(F.lit("Re: "), i % 7)),
        "body": F.when(i % 3 == 0, F.concat(F.lit("Number "), i))}).drop("id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    try:
        index = SUB.store_trigrams(df, str(tmp_path / "t"), buckets=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    grams = index.grams.filter("gram IS NOT NULL")
    blocks = index.grams.filter(F.col("bucket") == SUB.IDS).groupBy("field").agg(F.count("*").alias("n"), F.sum(F.size("message_ids")).alias("ids"))
    assert {tuple(r) for r in blocks.collect()} == {("subject", 2, n), ("body", 2, n)}
    assert grams.groupBy("gram", "field").count().filter("count > 2").isEmpty() and grams.count() < 5_000
    counts = {(r.gram, r.field): r.n for r in index.counts.collect()}
    assert counts["re:", "subject"] == sum(k % 11 > 0 for k in range(n)) and counts["num", "body"] == sum(k % 3 == 0 for k in range(n))
    for needle in ("RE: 3", "number 3299", "r 32", "31998", "nothing"):
        ids = lambda d: sorted(r[0] for r in d.select("message_id").collect())
        assert ids(SUB.containing(df, index, needle)) == ids(df.filter(S.text_predicate(needle)))
