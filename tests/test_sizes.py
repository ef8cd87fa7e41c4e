"""What is landed, shuffled and written by jobs on large archives: keys instead of texts, each text once."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from mailweave.operators import search as S, store as ST
from mailweave.session import folders, work_dir
from mailweave.sinks import export as X
from mailweave.sources import fixtures as fx
from mailweave.streaming import pipeline as SP
from test_mended import T0, labels, land, messages, raw


def landings(spark, *parts):
    return {f"{root}/{n}" for root in ["/".join([work_dir(spark), "mailweave", *parts])] for n in folders(spark, root)}


# --- F34
@pytest.mark.parametrize("order", ["ASC", "DESC"])
@pytest.mark.parametrize("field", ["size", "subject"])
def test_offset_lands_keys_only_and_counts_ties_and_nulls(spark, order, field):
    rows = [dict(message_id=f"m{i % 17}", size=i % 5, subject=None if i % 3 == 0 else f"s{i % 4}", body=f"body {i}") for i in range(60)]
    df = messages(spark, *rows).repartition(4)
    before = landings(spark, "page")
    whole = [(r[field], r["message_id"]) for r in df.orderBy(*S.ordering(df, S.SearchQuery(sort_field=field, sort_order=order))).collect()]
    for offset in (1, 8, 59, 75):
        got = S.page(df, S.SearchQuery(sort_field=field, sort_order=order, offset=offset))
        assert got.columns == df.columns and [(r[field], r["message_id"]) for r in got.collect()] == whole[offset:]
        assert {r["body"] for r in got.collect()} <= {f"body {i}" for i in range(60)} and got.select("body").distinct().count() == max(60 - offset, 0)
    new = landings(spark, "page") - before
    assert new and not any("body" in spark.read.parquet(p).columns for p in new)


# --- F2 to F5, F25
@pytest.mark.parametrize("fmt", ["csv", "json", "xml", "mbox", "html"])
def test_packed_export_holds_the_same_bytes(spark, tmp_path, fmt):
    df = messages(spark, *[dict(message_id=f"m{i}", subject=f"a, \"b\" {i}", body=f"line {i}\nFrom x <&>" * 20) for i in range(20)]).coalesce(1)

    def text(path, read):
        return b"".join(read(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    for packing in ("none", "gzip"):
        assert X.export(df, fmt, str(tmp_path / packing), options={"compression": packing})
    assert all(f.endswith(".gz") for f in os.listdir(tmp_path / "gzip") if f.startswith("part"))
    assert text(tmp_path / "gzip", gzip.open) == text(tmp_path / "none", lambda p: open(p, "rb"))


# --- F6, F7
def test_rewritten_buckets_are_written_once_and_nothing_is_left_beside(spark, tmp_path):
    path = ST.write_table(messages(spark, *[dict(message_id=f"m{i}", body=f"text {i}") for i in range(100)]), str(tmp_path / "t"), 8)
    before = landings(spark, "batch", "buckets")
    ids = spark.createDataFrame([(f"m{i}",) for i in range(0, 100, 3)], "message_id string")
    assert len(ST.mark_deleted_table(spark, path, ids, T0, 8)) == 8
    ST.upsert_table(spark, path, messages(spark, *[dict(message_id=f"m{i}", body="other", is_read=True) for i in range(90, 130)]), T0, 8)
    got = {r["message_id"]: r for r in ST.stored_table(spark, path).collect()}
    assert set(got) == {f"m{i}" for i in range(130)} and ST.stored_table(spark, path).count() == 130
    assert all(got[f"m{i}"]["body"] == (f"text {i}" if i < 100 else "other") and got[f"m{i}"]["is_read"] == (i >= 90) for i in range(130))
    assert all(got[f"m{i}"]["is_deleted"] == (i % 3 == 0) for i in range(90))
    assert landings(spark, "batch", "buckets") == before and {n for n in os.listdir(path) if not n.startswith(".")} - {"_SUCCESS"} == {f"bucket={b}" for b in range(8)}


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = ST.write_table(messages(spark, *[dict(message_id=f"m{i}") for i in range(20)]), str(tmp_path / "t"), 4)
    ids = spark.createDataFrame([("m1",)], "message_id string")
    with pytest.raises(Exception, match="broken"):
        ST._rewrite(spark, path, ids, lambda rows: rows.withColumn("subject", F.raise_error(F.lit("broken")).cast("string")), 4)
    assert ST.stored_table(spark, path).count() == 20


# --- F28: messages that lie under many changed ids are told apart where they lie
def test_lacking_keeps_repeated_and_null_ids(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "message_id string, x int")
    ids = spark.createDataFrame([("b",), ("b",), ("z",)], "message_id string")
    for most in (ST.BROADCAST_BYTES, 0):
        monkeypatch.setattr(ST, "BROADCAST_BYTES", most)
        assert sorted(r["x"] for r in ST.lacking(rows, ids).collect()) == [1, 2, 4, 5] and ST.lacking(rows, ids).columns == rows.columns


# --- F11 to F13
def test_parsed_stream_drops_repeats_without_raw_texts(spark, tmp_path):
    at, root, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    land(spark, at, raw("a", {}, internalDate="1700000000000"), raw("b", {}, internalDate="1700000000000"), "{broken")
    land(spark, at, raw("a", {}, internalDate="1700000000000"), "{broken", "{also")
    stream = SP.dedup_stream(SP.raw_stream(spark, at, 1), labels=labels(spark))
    write = SP.ingest_batches(root, labels)

    def body(batch, b):
        seen.extend((r["_reason"], r["value"]) for r in batch.collect())
        write(batch, b)
    SP.run_foreach_batch(stream, body, str(tmp_path / "ckpt"))
    good, bad = SP.ingested(spark, root)
    assert sorted(r["message_id"] for r in good.collect()) == ["a", "b"]
    assert sorted((r["value"], r["reason"]) for r in bad.collect()) == [("{also", "unparseable_json"), ("{broken", "unparseable_json")]
    assert all(value is None for reason, value in seen if reason is None) and len(seen) == 4


def test_drops_are_packed(spark, tmp_path):
    rows = spark.range(20).select(F.col("id"), F.concat(F.lit("text "), "id").alias("value"))
    SP.land_batches(rows, F.col("id"), 2, str(tmp_path / "d"), repeat=F.col("id") < 3)
    assert all(f.endswith(".txt.gz") for f in os.listdir(tmp_path / "d") if f.startswith("part"))
    assert SP.raw_landed(spark, str(tmp_path / "d")).count() == 23


# --- F33
def test_a_subject_is_cut_before_the_join(spark, tmp_path):
    texts = {0: "a" * 100, 1: "é😀" * 40, 2: None, 3: ""}
    spark.createDataFrame([*texts.items(), (1, "b" * 70)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [1, 2, 3, 4, 5, 6, 61, None, 9]                  # of 5 documents (key 1 twice, no key 4)
    spark.createDataFrame([(i, T0, 1, "view", 1.0) for i in ids], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = fx.flat_messages(spark, str(tmp_path)).select("event_id", "subject")
    held = {0: ["a" * 60], 1: ["é😀" * 30, "b" * 60], 2: [None], 3: [""]}
    want = [(i, None if i == 61 else t) for i in ids for t in (held.get(i % 5, [None]) if i is not None else [None])]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(plan) if "Join LeftOuter" in line)
    assert not any("substring(" in line for line in plan[:join]) and any("substring(" in line for line in plan[join:])
