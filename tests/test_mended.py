"""Behaviour that no size, depth, age or prefix may change: deep MIME trees,
many siblings, old mail after new, interrupted writes, text that looks like
markup, paging without gathering, hot threads, exact medians."""

import base64
import datetime as dt
import json
import statistics

import pytest
from pyspark.sql import functions as F

from mailweave import schema as SC
from mailweave.functions import dates as DT, text as TX
from mailweave.operators import analytics as A, attachments as AT, enrich as EN, index as IX, parse as P
from mailweave.operators import search as S, store as ST
from mailweave.session import folders
from mailweave.sinks import export as X
from mailweave.sources.files import attachment_files
from mailweave.streaming import pipeline as SP

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
ROW = dict(thread_id="t", sender={"name": "A", "email": "a@b"}, recipients={}, labels=["INBOX"], subject="s", body="b", size=1,
           timestamp=T0, is_read=False, is_outgoing=False, is_deleted=False, last_indexed=T0, custom_data=None)


def messages(spark, *rows):
    return spark.createDataFrame([{**ROW, **r} for r in rows], SC.MESSAGES)


def labels(_spark=None):
    return F.create_map(F.lit("INBOX"), F.lit("Inbox"))


def data(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def raw(mid, payload, **more):
    return json.dumps({"id": mid, "threadId": "t", "internalDate": "1704103200000", "payload": payload, **more})


def nested(depth, leaves):
    node = {"mimeType": "multipart/mixed", "parts": leaves}
    for _ in range(depth - 2):
        node = {"mimeType": "multipart/alternative", "parts": [node]}
    return {"mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/related", "parts": [node]}]}


@pytest.mark.parametrize("depth", [1, 2, 5, 6, 9, 40])
def test_parts_at_any_depth(spark, depth):
    leaves = [{"mimeType": "text/plain", "body": {"data": data(f"deep {depth}")}},
              {"mimeType": "application/pdf", "filename": "x.pdf", "body": {"attachmentId": "att", "size": 3}}]
    payload = {"mimeType": "multipart/related", "parts": leaves} if depth == 1 else nested(depth, leaves)
    if depth == 1:
        payload = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {"data": data("deep 1")}}, leaves[1]]}
    df = spark.createDataFrame([(raw("m", payload),)], "value string")
    good, bad = P.parse_messages(df, labels())
    assert good.first()["body"] == f"deep {depth}" and bad.count() == 0
    att = P.attachment_parts(df).collect()
    assert [a["attachment_id"] for a in att] == ["att"] and len(att[0]["path"].split(".")) == (1 if depth == 1 else depth + 1)


def test_escaped_parts_key_and_many_siblings(spark):
    inner = nested(8, [{"mimeType": "text/plain", "body": {"data": data("found")}}])
    many = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "x/y", "filename": str(i), "body": {"attachmentId": str(i)}}
                                                     for i in range(10_012)]}
    df = spark.createDataFrame([(raw("a", inner).replace('"parts"', '"p\\u0061rts"'),), (raw("b", many),)], "value string")
    good = {r["message_id"]: r for r in P.parse_messages(df, labels())[0].collect()}
    assert good["a"]["body"] == "found"
    parts = P.parts_table(df).filter("message_id = 'b'").select("path").collect()
    assert len({r["path"] for r in parts}) == 10_012 and {"0009", "9999", "10000", "10011"} <= {r["path"] for r in parts}


def test_body_order_and_undecodable_candidates(spark):
    payload = {"parts": [{"mimeType": "text/plain", "body": {"data": "!!not base64!!"}},
                         {"mimeType": "image/png", "body": {"data": data("never")}},
                         {"mimeType": "text/html", "body": {"data": data("<p>second</p>")}}]}
    df = spark.createDataFrame([(raw("m", payload),)], "value string")
    row = P.parse_variant(df, labels()).first()
    assert row["body"] == "second" and row["body_path"] == "0002"


def test_parse_runs_once(spark, tmp_path):
    spark.createDataFrame([(raw("m", {}),)], "value string").write.text(str(tmp_path / "raw"))
    good, _ = P.parse_messages(spark.read.text(str(tmp_path / "raw")), labels())
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("parse_json" in line.lower() or "ParseJson" in line for line in filters)


def test_markup_is_removed_and_text_stays(spark):
    cases = {"if a < b and c > d": "if a < b and c > d", "<P class='x'>a</p><br/>b": "ab", "1 <2 and 3> 2": "1 <2 and 3> 2",
             "<!DOCTYPE html><?xml v?><b>x</b>": "x", "<script>a<b</script>y<!-- <p> -->z": "yz",
             "it&#8217;s &mdash; caf&eacute; &#x41;&#65; &nope; &amp;lt; &#0; &#xD800; &#1114112;":
             "it’s — café AA &nope; &lt; &#0; &#xD800; &#1114112;", "a & b; c": "a & b; c", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["h"] for r in df.select("t", TX.html_to_text(F.col("t")).alias("h")).collect()} == cases


def test_named_zones_unknown_types_and_leading_space(spark):
    zones = {"Mon, 1 Jan 2024 12:00:00 EST": 17, "Mon, 1 Jan 2024 12:00:00 PDT": 19, "1 Jan 2024 12:00:00 -0500": 17,
             "Mon, 1 Jan 2024 12:00:00 GMT (x)": 12, "1 Jan 2024 12:00 cdt": 17}
    df = spark.createDataFrame([(k,) for k in zones], "s string")
    assert {r["s"]: r["t"].hour for r in df.select("s", DT.parse_rfc2822(F.col("s")).alias("t")).collect()} == zones
    raw_ = raw("m", {"parts": [{"mimeType": "x/unknown", "body": {"attachmentId": "a"}}]})
    assert P.attachment_parts(spark.createDataFrame([(raw_,)], "value string")).first()["filename"] == "attachment.bin"
    files = [(bytearray(b" " * 80 + b"\n<HTML>x"), "text/html"), (bytearray(b"plain <html>"), "application/octet-stream")]
    got = spark.createDataFrame(files, "content binary, want string").select(
        AT.sniff_mime(F.col("content"), F.lit("f")).alias("m"), "want").collect()
    assert all(r["m"] == r["want"] for r in got)


# --- streams -----------------------------------------------------------------------------------------------------

def land(spark, path, *texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(path)


def test_old_mail_after_new_and_quarantine(spark, tmp_path):
    at, root = str(tmp_path / "in"), str(tmp_path / "out")
    dated = lambda i, year: raw(i, {}, internalDate=str(int(dt.datetime(year, 1, 1).timestamp() * 1000)))
    for texts in ([dated("new1", 2024), dated("new2", 2024)], [dated("old1", 2003), "{broken"], [dated("old2", 1999), dated("new1", 2024)],
                  ["{broken", "{also"]):
        land(spark, at, *texts)
        stream = SP.dedup_stream(SP.raw_stream(spark, at, 1))
        SP.run_foreach_batch(stream, SP.ingest_batches(root, labels), str(tmp_path / "ckpt"))
    good, bad = SP.ingested(spark, root)
    assert sorted(r["message_id"] for r in good.collect()) == ["new1", "new2", "old1", "old2"]
    assert sorted((r["value"], r["reason"]) for r in bad.collect()) == [("{also", "unparseable_json"), ("{broken", "unparseable_json")]
    assert SP.raw_landed(spark, at).count() == 8


def test_replay_writes_what_is_missing(spark, tmp_path):
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    seed = messages(spark, dict(message_id="m1", subject="alpha"))
    SP.write_batch(seed, table, 0)
    IX.store_index(seed, index)
    body = SP.upsert_batches(table, T0, index)
    later = [messages(spark, dict(message_id="m2", subject="beta"), dict(message_id="m1", subject="changed", is_read=True)),
             messages(spark, dict(message_id="m3", subject="gamma"))]
    SP.upsert_batches(table, T0)(later[0], 0)          # the job ends between its two writes
    assert not IX.indexed(spark, index, 1) and SP.committed(spark, table, 1)
    body(later[0], 0)                                  # replay of the same batch
    body(later[0], 0)
    body(later[1], 1)
    terms = {(r["term"], r["message_id"]) for r in SP.read_index(spark, index).filter("field = 'subject'").collect()}
    assert terms == {("alpha", "m1"), ("beta", "m2"), ("gamma", "m3")}
    now = {r["message_id"]: r for r in SP.read_table(spark, table).collect()}
    assert set(now) == {"m1", "m2", "m3"} and now["m1"]["subject"] == "alpha" and now["m1"]["is_read"]
    small = SP.compact(spark, table, str(tmp_path / "c"))
    assert folders(spark, small) == ["batch=000000000000"] and SP.read_table(spark, small).count() == 3


def test_hooks_and_filters_around_saving(spark, tmp_path):
    reg, seen = EN.Registry(), []
    reg.get_hook("before_database_save").add(lambda b: seen.append(("before", b)))
    reg.get_hook("after_database_save").add(lambda b: seen.append(("after", b)))
    reg.get_filter("message_content").add(EN.redact_body)
    table = str(tmp_path / "t")
    SP.upsert_batches(table, T0, registry=reg)(messages(spark, dict(message_id="m", body="1234 5678 9012 3456")), 0)
    assert seen == [("before", 1), ("after", 1)] and "REDACTED" in SP.read_table(spark, table).first()["body"]
    reg.get_filter("search_query").add(lambda q: S.build_query(limit=1, filters=q.filters))
    assert reg.apply_filter("search_query", S.build_query(limit=50)).limit == 1


def test_small_batch_leaves_the_table_in_place(spark, tmp_path):
    stored = messages(spark, *[dict(message_id=f"m{i}") for i in range(50)])
    stored.write.parquet(str(tmp_path / "t"))
    out = ST.upsert(spark.read.schema(SC.MESSAGES).parquet(str(tmp_path / "t")), messages(spark, dict(message_id="m7", is_read=True)), T0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert out.filter("is_read").count() == 1 and out.count() == 50


def test_ties_in_a_batch_are_broken_alike(spark):
    rows = [dict(message_id="m", labels=[x], subject=x) for x in "abcd"]
    got = {tuple(ST.latest_per_id(messages(spark, *r).repartition(n)).first()["labels"]) for r in (rows, rows[::-1]) for n in (1, 3)}
    assert got == {("d",)}
    stats = A.contacts(messages(spark, *[dict(message_id=f"m{i}", sender={"name": f"N{i}", "email": "a@b"}) for i in range(5)]), 5, T0)
    assert stats.first()["name"] == "N4"


# --- search, analytics, export -----------------------------------------------------------------------------------

def test_offset_without_limit(spark):
    df = messages(spark, *[dict(message_id=f"m{i:03d}", size=i % 7) for i in range(200)]).repartition(5)
    want = sorted(((i % 7, f"m{i:03d}") for i in range(200)))
    for offset in (0, 1, 99, 199, 200, 500):
        page, _ = S.search(df, S.build_query(sort_field="size", sort_order="ASC", offset=offset))
        assert [(r["size"], r["message_id"]) for r in page.collect()] == want[offset:]
        assert "CollectLimit" not in page._jdf.queryExecution().executedPlan().toString()


def test_replies_across_days_and_exact_median(spark):
    rows = [dict(message_id=f"m{i:03d}", is_outgoing=bool(i % 3), timestamp=T0 + dt.timedelta(minutes=37 * i * (1 + i % 5)))
            for i in range(90)]
    order = sorted(rows, key=lambda r: (r["timestamp"], r["message_id"]))
    pairs = [(a, b) for a, b in zip(order, order[1:], strict=False) if b["is_outgoing"] and not a["is_outgoing"]]
    df = messages(spark, *rows)
    assert sorted((r["incoming_id"], r["reply_id"]) for r in A.replies(df).collect()) == \
        sorted((a["message_id"], b["message_id"]) for a, b in pairs)
    hours = [(b["timestamp"] - a["timestamp"]).total_seconds() / 3600 for a, b in pairs]
    assert A.response_stats(df).first()["median_response_hours"] == pytest.approx(statistics.median(hours))
    assert A.response_stats(df.limit(0)).first()["median_response_hours"] == 0.0
    for values in ([5], [1, 9], [3, 3, 3, 10], list(range(0, 1000, 7))):
        r = A.exact_median(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()
        assert (r["lo"] + r["hi"]) / 2 == statistics.median(values)


def test_stored_index_prunes_and_finds_long_phrases(spark, tmp_path):
    df = messages(spark, dict(message_id="a", body="one two three four five"), dict(message_id="b", body="two three one four five"),
                  dict(message_id="c", body="three four", subject="one two three four"), dict(message_id="d", body=None, subject=None))
    ix = IX.store_index(df, str(tmp_path / "ix"), buckets=8)
    phrase = lambda *t: spark.createDataFrame(list(enumerate(t)), "i int, term string")
    ids = lambda f: sorted(r["message_id"] for r in f.collect())
    assert ids(IX.match_phrase(ix, phrase("one", "two", "three", "four"))) == ["a", "c"]
    assert ids(IX.match_phrase(ix, phrase("four", "five"), ["body"])) == ["a", "b"] and ids(IX.match_prefix(ix, "FIV")) == ["a", "b"]
    terms = spark.createDataFrame([("one",), ("two",)], "term string")
    assert "dynamicpruning" in IX.match_any(ix, terms)._jdf.queryExecution().executedPlan().toString().lower()
    page, hits = IX.search(df, ix, S.build_query(sort_field="message_id", sort_order="ASC", limit=1), terms=terms, prefix="fi")
    assert ids(page) == ["a"] and hits.count() == 2


def test_html_export_keeps_whole_bodies_and_new_formats(spark, tmp_path):
    df = messages(spark, dict(message_id="m", body="x" * 5000 + '"<&'))
    html = [r["html"] for r in X.render_html(df).orderBy("part").collect()]
    assert "x" * 5000 + "&quot;&lt;&amp;" in html[1] and "1 messages" in html[2]
    assert "x" * 11 not in X.render_html(df, body_limit=10).orderBy("part").collect()[1]["html"]
    X.register_writer("ids", lambda d, path, upper=False: d.select("message_id").write.text(path), {"upper": False})
    try:
        assert X.export(df, "ids", str(tmp_path / "ids")) and spark.read.text(str(tmp_path / "ids")).count() == 1
        assert X.format_options("ids") == {"upper": False} and not X.export(df, "none", str(tmp_path / "n"))
    finally:
        del X.WRITERS["ids"], X.FORMAT_OPTIONS["ids"]


def test_versions_files_and_adapters(spark, tmp_path):
    at = str(tmp_path / "v")
    assert SC.read_version(spark, at) == 0
    SC.write_version(spark, at, 5)
    assert SC.read_version(spark, at) == 5
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "a.txt").write_bytes(b"abc")
    f = attachment_files(spark, str(tmp_path), "*.txt").first()
    assert (f["message_id"], f["filename"], f["length"], bytes(f["content"])) == ("m1", "a.txt", 3, b"abc")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v long")
    top = EN.grouped_transform(df, ["k"], lambda g: g.nlargest(1, "v"), "k string, v long")
    assert sorted(map(tuple, top.collect())) == [("a", 2), ("b", 5)]
    many = EN.expanded(df, lambda r: [{"k": r["k"], "i": i} for i in range(r["v"] - 1)], "k string, i long")
    assert sorted(map(tuple, many.collect())) == [("a", 0), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]


# --- raw texts are made and parsed once ------------------------------------------------------
def test_filters_hold_no_second_copy_of_the_raw_text(spark):
    import __spark_entry__ as entry
    for key in ("label_names", "part_walk", "body_select"):
        plan = entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "replace(" in line], key


def test_base64_with_white_space_and_without_padding(spark):
    from mailweave.functions.mime import b64url_decode, b64url_encode
    texts = ["", "a", "ab?>", "ÿþ~~ß日本" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.rtrim(b64url_encode(F.col("t")), F.lit("="))
    wide = F.regexp_replace(bare, "(.{3})", "$1 \n\t\r\f\x0b")
    got = rows.select("t", b64url_decode(bare).alias("a"), b64url_decode(wide).alias("b")).collect()
    assert all(r.t == r.a == r.b for r in got)
    assert spark.range(1).select(b64url_decode(F.lit("!!YQ")).alias("x")).first().x is None
