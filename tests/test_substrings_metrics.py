"""Trigram search against scans, the stored metric history, markup as a parser reads it, page order."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from mailweave.functions import text as TX
from mailweave.operators import analytics as A, search as S, substrings as SUB
from mailweave.sinks import export as X
from test_mended import T0, messages


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    words = ["Alpha beta", "gamma DELTA", "übung straße", "日本語テスト", "a%b_c", "aaaa", "xy", "", None, "beta\nalpha 😀😀😀 end"]
    rows = [dict(message_id=f"m{i}", subject=words[i % 10], body=None if i % 7 == 0 else f"{words[(i * 3) % 10]} tail{i}",
                 sender={"name": "n", "email": f"User{i % 4}@Mail.example"}) for i in range(60)]
    df = messages(spark, *rows).cache()
    return df, SUB.store_trigrams(df, str(tmp_path_factory.mktemp("tri")), ("subject", "body", "sender_email"), buckets=8)


@pytest.mark.parametrize("needle", ["alpha", "BETA", "ta\nal", "übung", "straß", "日本語", "本語テ", "%b_", "aaa", "aaaaa", "tail1", "😀😀😀", "a 😀😀", "xy", "q", "zzz", "tail59"])
def test_substrings_equal_a_scan(archive, needle):
    df, index = archive
    ids = lambda d: sorted(r["message_id"] for r in d.select("message_id").collect())
    assert ids(SUB.containing(df, index, needle)) == ids(df.filter(S.text_predicate(needle)))


@pytest.mark.parametrize("partial", ["alp", "user", "user3", "us", "zzz"])
def test_suggestions_equal_a_scan(archive, partial):
    df, index = archive
    assert [r[0] for r in SUB.suggestions(df, index, partial, 6).collect()] == [r[0] for r in S.suggestions(df, partial, 6).collect()]


def test_only_the_runs_buckets_are_read(archive):
    plan = SUB.candidates(archive[1], "alpha", "subject")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket").replace("[[", "[") and "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "").replace("IsNotNull(field), ", "")


def test_metric_history_keeps_untouched_days(spark, tmp_path):
    path = str(tmp_path / "h")
    day = lambda d: dt.date(2024, 1, d)
    rows = lambda *r: spark.createDataFrame([(day(d), m, float(v)) for d, m, v in r], "date date, metric_name string, metric_value double")
    A.store_metrics(rows((1, "a", 1), (1, "b", 2), (2, "a", 3), (3, "a", 4)), path)
    files = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("date=")}
    before = files()
    for _ in range(2):
        A.store_metrics(rows((1, "b", 20), (4, "a", 5)), path)
        got = sorted((r["date"].day, r["metric_name"], r["metric_value"]) for r in A.read_metrics(spark, path).collect())
        assert got == [(1, "a", 1.0), (1, "b", 20.0), (2, "a", 3.0), (3, "a", 4.0), (4, "a", 5.0)]
    after = files()
    assert after["date=2024-01-02"] == before["date=2024-01-02"] and after["date=2024-01-03"] == before["date=2024-01-03"]
    assert after["date=2024-01-01"] != before["date=2024-01-01"]
    A.store_metrics(rows((9, "a", 1)).limit(0), path)
    assert files() == after


def test_quotes_and_unclosed_markup(spark):
    cases = {'<a title="x > y">b</a>': "b", "<a title='>'  href = \">\">c</a>d": "cd", "x<!-- never closed <b>y": "x",
             "<p title=it's>foo's</p>": "foo's", '<a href="x>y</a>z': "yz", "<script>1</style>2</script>3": "3", "a<style>p{}": "a",
             "<!-- a --><!-- b > c -->d": "d", "<b" + ' k="v"' * 20_000 + ">e": "e", "<" * 20_000: "<" * 20_000, "<a " + "=" * 50_000: "<a " + "=" * 50_000}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["h"] for r in df.select("t", TX.html_to_text(F.col("t")).alias("h")).collect()} == cases


def test_page_stands_newest_first(spark, tmp_path):
    df = messages(spark, *[dict(message_id=f"m{i}", timestamp=T0 + dt.timedelta(hours=(i * 7) % 5)) for i in range(5)], dict(message_id="a", timestamp=T0))
    X.write_html(df, str(tmp_path / "h"))
    text = "".join(open(tmp_path / "h" / f).read() for f in sorted(os.listdir(tmp_path / "h")) if f.startswith("part"))
    at = {i: text.index(f'id="{i}"') for i in ("m0", "m1", "m2", "m3", "m4", "a")}
    assert sorted(at, key=at.get) == ["m2", "m4", "m1", "m3", "a", "m0"] and text.startswith("<!doctype") and text.rstrip().endswith("</html>")
