"""Unit tests on tiny hand-made frames (SURVEY §5 strategy (c), (e))."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mailweave import schema as SC
from mailweave.functions import addresses as AD, text as TX
from mailweave.operators import analytics as A, attachments as AT, enrich as EN, parse as P
from mailweave.operators import search as S, store as ST
from mailweave.sinks import export as X


def _msgs(spark, rows):
    """rows: (id, thread, email, name, size, ts, is_read, is_outgoing, is_deleted, subject, body)"""
    data = [dict(message_id=r[0], thread_id=r[1], sender={"name": r[3], "email": r[2]}, recipients={},
                 labels=["INBOX"], subject=r[9], body=r[10], size=r[4], timestamp=r[5], is_read=r[6],
                 is_outgoing=r[7], is_deleted=r[8], last_indexed=r[5], custom_data=None) for r in rows]
    return spark.createDataFrame(data, SC.MESSAGES)


T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def test_reference_address_list(spark):
    df = spark.range(1).select(AD.parse_address_list(
        F.lit("test@example.com, John Doe <john@example.com>")).alias("a"))
    a = df.first()["a"]
    assert [(x["email"], x["name"]) for x in a] == [("test@example.com", ""), ("john@example.com", "John Doe")]


def test_reference_minimal_raw_message(spark):
    raw = {"id": "test123", "threadId": "thread123", "sizeEstimate": 1000,
           "payload": {"headers": [{"name": "Subject", "value": "Test Subject"},
                                   {"name": "From", "value": "test@example.com"},
                                   {"name": "Date", "value": "Mon, 1 Jan 2024 12:00:00 +0000"}]}}
    df = spark.createDataFrame([(json.dumps(raw),), ("{}",), ("{broken",)], "value string")
    labels = F.create_map(F.lit("INBOX"), F.lit("INBOX"))
    good, bad = P.parse_messages(df, labels)
    g = good.collect()
    assert len(g) == 1
    assert (g[0]["message_id"], g[0]["thread_id"], g[0]["subject"]) == ("test123", "thread123", "Test Subject")
    assert g[0]["size"] == 1000 and g[0]["is_read"] is False and g[0]["labels"] == []
    assert g[0]["timestamp"] == dt.datetime(2024, 1, 1, 12, 0, 0)
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["missing_id", "unparseable_json"]


def test_header_last_wins_case_insensitive(spark):
    raw = {"id": "a", "threadId": "t", "internalDate": "1704103200000",
           "payload": {"headers": [{"name": "subject", "value": "old"}, {"name": "SUBJECT", "value": "new"}]}}
    g, _ = P.parse_messages(spark.createDataFrame([(json.dumps(raw),)], "value string"),
                            F.create_map(F.lit("x"), F.lit("y")))
    assert g.first()["subject"] == "new"


def test_size_bucket_borders(spark):
    sizes = [1023, 1024, 10240, 102400, 1048576, 1048577]
    df = _msgs(spark, [(f"m{i}", "t", "a@b", "A", s, T0, True, False, False, "s", "b") for i, s in enumerate(sizes)])
    r = A.size_analysis(df).first()
    assert (r["very_small"], r["small"], r["medium"], r["large"], r["very_large"]) == (1, 2, 2, 2, 1)


def test_filter_errors(spark):
    df = _msgs(spark, [("m1", "t", "a@b", "A", 1, T0, True, False, False, "s", "b")])
    with pytest.raises(ValueError):
        S.compile_filter(df, S.SearchFilter("size", "regex", 1))
    with pytest.raises(ValueError):
        S.compile_filter(df, S.SearchFilter("size", "between", [1]))
    with pytest.raises(ValueError):
        S.compile_filter(df, S.SearchFilter("no_such", "eq", 1))


def test_offset_without_limit_and_total(spark):
    rows = [(f"m{i}", "t", "a@b", "A", i, T0 + dt.timedelta(hours=i), True, False, False, "s", "b")
            for i in range(10)]
    df = _msgs(spark, rows)
    page, matched = S.search(df, S.build_query(offset=3, sort_field="size", sort_order="ASC"))
    assert [r["size"] for r in page.collect()] == list(range(3, 10))
    assert matched.count() == 10


def test_upsert_keeps_content_columns(spark):
    old = _msgs(spark, [("m1", "t", "a@b", "A", 5, T0, False, False, True, "orig", "b")])
    new = _msgs(spark, [("m1", "t2", "x@y", "X", 9, T0, True, True, False, "changed", "c"),
                        ("m2", "t", "a@b", "A", 7, T0, True, False, False, "s2", "b")])
    out = {r["message_id"]: r for r in ST.upsert(old, new, dt.datetime(2024, 2, 1)).collect()}
    m1 = out["m1"]
    assert (m1["subject"], m1["size"], m1["thread_id"], m1["is_read"], m1["is_deleted"]) == ("orig", 5, "t", True, False)
    assert m1["last_indexed"] == dt.datetime(2024, 2, 1)
    assert "m2" in out


def test_mark_deleted_empty_is_noop(spark):
    df = _msgs(spark, [("m1", "t", "a@b", "A", 5, T0, False, False, False, "s", "b")])
    ids = spark.createDataFrame([], "message_id string")
    assert ST.mark_deleted(df, ids).first()["is_deleted"] is False


def test_schema_evolution_idempotent(spark):
    df = _msgs(spark, [("m1", "t", "a@b", "A", 5, T0, False, False, False, "s", "b")]).drop("is_deleted")
    once = SC.evolve_schema(df, 0)
    twice = SC.evolve_schema(once, SC.CURRENT_SCHEMA_VERSION)
    assert once.first()["is_deleted"] is False and twice.columns == once.columns


def test_contacts_newest_name_and_fallback(spark):
    rows = [("m1", "t", "a@b", "Old", 1, T0, True, False, False, "s", "b"),
            ("m2", "t", "a@b", "New", 1, T0 + dt.timedelta(days=1), True, True, False, "s", "b"),
            ("m3", "t", "c@d", "", 1, T0, True, False, False, "s", "b"),
            ("m4", "t", "c@d", "", 1, T0, True, False, False, "s", "b")]
    out = {r["email"]: r for r in A.contacts(_msgs(spark, rows), 50, dt.datetime(2024, 1, 3)).collect()}
    assert out["a@b"]["name"] == "New" and out["c@d"]["name"] == "c@d"
    assert out["a@b"]["sent_count"] == 1 and out["a@b"]["received_count"] == 1


def test_response_time_window(spark):
    rows = [("m1", "t", "x@y", "X", 1, T0, True, False, False, "s", "b"),
            ("m2", "t", "me@z", "Me", 1, T0 + dt.timedelta(hours=2), True, True, False, "s", "b"),
            ("m3", "t", "me@z", "Me", 1, T0 + dt.timedelta(hours=3), True, True, False, "s", "b")]
    r = A.contact_response(_msgs(spark, rows)).collect()
    assert [(x["email"], x["avg_response_hours"], x["replies"]) for x in r] == [("x@y", 2.0, 1)]


def test_html_to_text_and_redaction(spark):
    r = spark.range(1).select(
        TX.html_to_text(F.lit("<!-- c --><style>p{}</style><p>a &amp; b &lt;c&gt;</p>")).alias("h"),
        TX.redact_cards(F.lit("card 1234 5678-9012 3456 end")).alias("c")).first()
    assert r["h"] == "a & b <c>"
    assert r["c"] == "card [CREDIT_CARD_REDACTED] end"


def test_phone_and_urgency_enrichment(spark):
    rows = [("m1", "t", "a@b", "A", 1, T0, False, False, False, "URGENT: call", "ring 555-123-4567 or 555-765-4321"),
            ("m2", "t", "a@b", "A", 1, T0, True, False, False, "urgent", "555-123-4567")]
    out = {r["message_id"]: r["custom_data"] for r in EN.urgency_and_phones(_msgs(spark, rows)).collect()}
    assert out["m1"] == {"priority": "urgent", "phone_numbers": "555-123-4567,555-765-4321"}
    assert out["m2"] is None


def test_transform_chain_order_and_skip(spark):
    df = spark.createDataFrame([("a",)], "x string")
    reg = EN.Registry()
    ch = reg.get_filter("export_data")
    ch.add(lambda d: d.withColumn("x", F.concat("x", F.lit("2"))), priority=1)
    ch.add(lambda d: d.withColumn("x", F.concat("x", F.lit("1"))), priority=9)
    ch.add(lambda d: d.withColumn("x", F.col("missing")), priority=5)
    assert reg.apply_filter("export_data", df).first()["x"] == "a12"
    calls = []
    h = reg.get_hook("sync_complete")
    h.add(lambda: calls.append("b") or "b", priority=1)
    h.add(lambda: calls.append("a") or "a", priority=2)
    h.add(lambda: 1 / 0, priority=3)
    assert reg.call_hook("sync_complete") == ["a", "b"]


def test_export_helpers():
    assert X.available_formats() == ["csv", "json", "xml", "mbox", "html"]
    assert X.format_options("csv")["delimiter"] == "," and X.format_options("nope") == {}
    assert X.xml_name("1st name!") == "field_1st_name_" and X.xml_name("") == "unknown_field"


def test_safe_name_keeps_extension(spark):
    long = "a" * 300 + ".pdf"
    r = spark.range(1).select(AT.safe_name(F.lit(long)).alias("s"), AT.safe_name(F.lit('a<b>:"c.txt')).alias("t")).first()
    assert len(r["s"]) == 255 and r["s"].endswith(".pdf") and r["t"] == "a_b___c.txt"


def test_attachment_text_latin1_and_utf16(spark):
    df = spark.createDataFrame([(bytearray("café".encode("latin-1")),), (bytearray("hé".encode("utf-16")),)],
                               "content binary")
    r = df.select(AT.text_content(F.col("content"), F.lit("text/plain")).alias("t")).collect()
    assert [x["t"] for x in r] == ["café", "hé"]
