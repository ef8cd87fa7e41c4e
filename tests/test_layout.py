"""Overlays that leave untouched rows in place, the table laid out by id, replies by ranges, the sketched median."""

import datetime as dt
import os
import statistics

import pytest
from pyspark.sql import functions as F

from mailweave.operators import analytics as A, store as ST
from mailweave.streaming import pipeline as SP
from test_mended import T0, messages

LATER = dt.datetime(2024, 2, 1)


def flat(df):
    return sorted((r["message_id"], r["subject"], r["body"], r["is_read"], r["is_deleted"], tuple(r["labels"]), r["last_indexed"]) for r in df.collect())


def sample(spark, ids, **more):
    return messages(spark, *[dict(message_id=f"m{i}", subject=f"s{i}", body=f"body {i}", **more) for i in ids])


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_overlay_and_upsert_with_and_without_broadcast(spark, monkeypatch, limit):
    base, inc = sample(spark, range(300)), sample(spark, range(200, 420, 3), is_read=True, labels=["X"])
    want = flat(ST.upsert(base, inc, LATER))
    monkeypatch.setattr(ST, "BROADCAST_BYTES", limit)
    assert flat(ST.upsert(base, inc, LATER)) == want
    ids = sample(spark, range(0, 500, 7)).select("message_id")
    got = {r["message_id"] for r in ST.mark_deleted(base, ids, LATER).collect() if r["is_deleted"]}
    assert got == {f"m{i}" for i in range(0, 300, 7)}
    assert {r["message_id"] for r in ST.matching(base, ids).collect()} == got
    assert flat(ST.mark_deleted(base, ids.limit(0), LATER)) == flat(base)


def test_bitmap_split_loses_nothing(spark):
    base = sample(spark, range(1000))
    may, others = ST._split(base, sample(spark, range(0, 1000, 9)).select("message_id"))
    hit = {r["message_id"] for r in may.collect()}
    assert {f"m{i}" for i in range(0, 1000, 9)} <= hit and len(hit) < 150
    assert {r["message_id"] for r in others.collect()} == {f"m{i}" for i in range(1000)} - hit


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_stream_table_reads_stored_texts_in_place(spark, tmp_path, monkeypatch, limit):
    table = str(tmp_path / "t")
    SP.write_batch(sample(spark, range(50)), table, 0)
    SP.write_batch(sample(spark, range(45, 60), is_read=True), table, 1)
    SP.write_batch(messages(spark, dict(message_id="m55", subject="other", labels=["L"]), dict(message_id="m3", subject="other", labels=["L"])), table, 2)
    monkeypatch.setattr(ST, "BROADCAST_BYTES", limit)
    got = {r["message_id"]: r for r in SP.read_table(spark, table).collect()}
    assert set(got) == {f"m{i}" for i in range(60)}
    assert all(got[f"m{i}"]["subject"] == f"s{i}" for i in range(60))
    assert [i for i in range(60) if got[f"m{i}"]["is_read"]] == [i for i in range(45, 60) if i != 55]
    assert [i for i in range(60) if got[f"m{i}"]["labels"] == ["L"]] == [3, 55]
    if limit > 0:   # batch 0's rows meet no exchange: its scan lies below a broadcast join
        plan = SP.read_table(spark, table)._jdf.queryExecution().executedPlan().toString()
        base = next(p for p in plan.split("Union")[1].split("FileScan") if "body" in p)
        assert "Exchange hashpartitioning" not in plan.split("Union")[1].split("FileScan")[0], base[:100]


def times(path):
    return {d: {f: os.stat(os.path.join(path, d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, d))}
            for d in os.listdir(path) if d.startswith("bucket=")}


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    path = ST.write_table(sample(spark, range(200)), str(tmp_path / "t"), 16)
    before = times(path)
    touched = ST.upsert_table(spark, path, sample(spark, [7], is_read=True, labels=["X"]), LATER, 16)
    after = times(path)
    assert len(touched) == 1 and {d for d in after if after[d] != before[d]} == {f"bucket={touched[0]}"}
    rows = {r["message_id"]: r for r in ST.stored_table(spark, path).collect()}
    assert len(rows) == 200 and [i for i, r in rows.items() if r["is_read"]] == ["m7"] and rows["m7"]["last_indexed"] == LATER
    assert ST.upsert_table(spark, path, sample(spark, [900]), LATER, 16) and ST.stored_table(spark, path).count() == 201
    ids = spark.createDataFrame([("m9",), ("none",)], "message_id string")
    assert len(ST.mark_deleted_table(spark, path, ids, LATER, 16)) == 1
    before = times(path)
    assert ST.mark_deleted_table(spark, path, ids, LATER, 16) == [] and times(path) == before      # marked already
    assert [r["message_id"] for r in ST.stored_table(spark, path).filter("is_deleted").collect()] == ["m9"]


def test_replies_in_one_thread_on_one_day_spread(spark):
    rows = [dict(message_id=f"m{i:05d}", thread_id="hot", timestamp=T0 + dt.timedelta(seconds=(i * 7919) % 5000 // 3), is_outgoing=(i * 31) % 7 < 3,
                 sender={"name": "n", "email": f"e{i % 5}"}) for i in range(3000)]
    rows += [dict(message_id=f"x{i}", thread_id=f"t{i % 40}", timestamp=T0 + dt.timedelta(minutes=i), is_outgoing=i % 3 == 0) for i in range(200)]
    df = messages(spark, *rows)
    want, last = set(), {}
    for r in sorted(rows, key=lambda r: (r["thread_id"], r["timestamp"], r["message_id"])):
        p = last.get(r["thread_id"])
        if p and r["is_outgoing"] and not p["is_outgoing"]:
            want.add((p["message_id"], r["message_id"], (r["timestamp"] - p["timestamp"]) // dt.timedelta(microseconds=1)))
        last[r["thread_id"]] = r
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = A.replies(df)
        assert {(r["incoming_id"], r["reply_id"], r["response_micros"]) for r in got.collect()} == want
        ranges = got.select(F.col("incoming_id"), F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(ranges) > 3 and max(r["count"] for r in ranges) < 0.6 * len(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("bracket", [1_000_000, 0])
def test_median_by_brackets(spark, monkeypatch, bracket):
    """With no rows allowed in a bracket it is narrowed while the rows left call for it."""
    monkeypatch.setattr(A, "BRACKET_ROWS", bracket)
    for values in ([5], [1, 9], [3, 3, 3, 10], list(range(0, 1000, 7)), [7] * 500 + [9] * 500, [((i * 7919) % 10007) ** 2 for i in range(20_000)]):
        r = A.exact_median(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()
        assert (r["lo"] + r["hi"]) / 2 == statistics.median(values)
    r = A.exact_median(spark.createDataFrame([], "v long"), "v").first()
    assert r["lo"] is None and r["hi"] is None
