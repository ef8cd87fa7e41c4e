"""Full-text index and search queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import index as IX
from ..operators import search as S
from ..operators import store as ST
from ..session import scratch_path, stamp
from ..sources import fixtures as fx
from .registry import ORACLES, register
from .sqlfrag import M

TOKS = "list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _docs_sql(src: str) -> str:
    parts = [f"SELECT message_id, '{f}' AS field, {e} AS txt FROM {src}" for f, e in [
        ("subject", "subject"), ("body", "body"), ("sender_email", "sender_email"),
        ("sender_name", "sender_name"), ("recipients", "concat_ws(' ', to_email, cc_email)")]]
    return " UNION ALL ".join(parts)


def _index_ctes(src: str = "m") -> list[str]:
    return [
        f"docs AS ({_docs_sql(src)})",
        f"tok AS (SELECT message_id, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos "
        f"FROM (SELECT message_id, field, {TOKS.format(x='txt')} AS t FROM docs))",
        "post AS (SELECT term, field, message_id, count(*) AS tf, min(pos) AS first_pos FROM tok GROUP BY ALL)",
    ]


KW_CTES = [
    "bdf AS (SELECT term, count(*) AS df FROM post WHERE field = 'body' GROUP BY term)",
    "kw_freq AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS r FROM bdf "
    "QUALIFY r <= 2)",
    "kw_rare AS (SELECT term FROM bdf WHERE df >= 2 ORDER BY df, term LIMIT 2)",
]


def sql(body: str, *ctes: str, src: str = "m") -> str:
    return "WITH " + ", ".join([M, *_index_ctes(src), *KW_CTES, *ctes]) + "\n" + body


def _m(spark, sf):
    return fx.messages(spark, sf)


_STORED: dict[tuple, str] = {}


def _index(spark, sf):
    """The archive's stored index: built by the first query of a session that needs it,
    read by the others as long as the archive's files stay the same."""
    key = (spark.sparkContext.applicationId, sf, *[stamp(spark, f"{sf.rstrip('/')}/{t}.parquet") for t in ("events", "documents")])
    if key not in _STORED:
        path = scratch_path(spark, "index")
        IX.store_index(_m(spark, sf), path)
        _STORED[key] = path
    return IX.load_index(spark, _STORED[key])


def _kw(ix):
    """``kw``: 2 most frequent (r 1, 2) and 2 rarest (df >= 2) body terms, from the
    stored document frequencies."""
    df = ix.frequencies.filter(F.col("field") == "body").select("term", "df")
    freq = df.orderBy(F.col("df").desc(), "term").limit(2)
    freq = freq.withColumn("r", F.row_number().over(Window.orderBy(F.col("df").desc(), "term")))   # two rows
    rare = df.filter(F.col("df") >= 2).orderBy("df", "term").limit(2)
    return freq.select("term", "r"), rare.select("term")


def _ids(df):
    return df.select("message_id")


@register("fts_index", sql("SELECT term, field, message_id, tf, first_pos FROM post"))
def q_fts_index(spark, sf):
    p = IX.build_index(_m(spark, sf))
    return p.select("term", "field", "message_id", "tf", F.element_at("positions", 1).alias("first_pos"))


@register("fts_store", sql("""SELECT term, field, count(*) AS df, count_if(live) AS df_live
FROM post JOIN (SELECT message_id, NOT is_deleted AS live FROM m) USING (message_id) GROUP BY term, field"""))
def q_fts_store(spark, sf):
    """D1 as a stored index: every table of it is written; its term dictionary comes back."""
    ix = IX.store_index(_m(spark, sf), scratch_path(spark, "index"))
    return ix.frequencies.select("term", "field", "df", "df_live")


def _segmented(spark, sf, merged):
    """An index grown in steps: a seed, two batches of new messages (one repeating
    ids), a batch of changed and removed ones, and deletion flags; then merged or not.
    It ends up with the archive's messages, current texts and flags."""
    m = _m(spark, sf)
    k = F.substring("message_id", 2, 20).cast("bigint")
    path = scratch_path(spark, "index")
    early = m.withColumn("is_deleted", F.lit(False))
    stale = F.when(k % 7 == 3, F.concat(F.lit("draft "), F.coalesce("subject", F.lit("")))).otherwise(F.col("subject"))
    IX.store_index(early.filter(k % 4 == 0).withColumn("subject", stale), path, buckets=16)
    IX.extend(spark, path, early.filter(k % 4 == 1).withColumn("subject", stale), 1)
    IX.extend(spark, path, early.filter((k % 4 == 2) | (k % 8 == 1)), 2)            # ids of 8 n + 1 are known
    if merged:
        IX.merge(spark, path)
    gone = m.filter(k % 28 == 3).select(F.concat(F.lit("x"), "message_id").alias("message_id"))
    IX.replace(spark, path, m.filter((k % 4 == 3) | (k % 7 == 3)), 3, removed=gone)
    IX.flag(spark, path, m.filter("is_deleted").select("message_id"), False, 4)
    return IX.merge(spark, path) if merged else IX.load_index(spark, path)


@register("fts_segments", sql("SELECT term, field, message_id, tf, first_pos, NOT is_deleted AS live FROM post JOIN (SELECT message_id, is_deleted FROM m) USING (message_id)"))
def q_fts_segments(spark, sf):
    """The postings of an index that change sets have grown, unmerged."""
    return _segmented(spark, sf, False).postings.select("term", "field", "message_id", "tf", F.element_at("positions", 1).alias("first_pos"), "live")


@register("fts_all", sql("""SELECT message_id FROM live WHERE message_id IN (
  SELECT message_id FROM post WHERE term IN (SELECT term FROM kw_freq)
  GROUP BY message_id HAVING count(DISTINCT term) = 2)"""))
def q_fts_all(spark, sf):
    ix = _index(spark, sf)
    freq, _ = _kw(ix)
    return _ids(IX.join_back(_m(spark, sf), IX.match_all(ix, freq)))


@register("fts_any", sql("""SELECT message_id FROM live WHERE message_id IN (
  SELECT message_id FROM post WHERE term IN (SELECT term FROM kw_rare))"""))
def q_fts_any(spark, sf):
    ix = _index(spark, sf)
    _, rare = _kw(ix)
    return _ids(IX.join_back(_m(spark, sf), IX.match_any(ix, rare)))


@register("fts_not", sql("""SELECT message_id FROM live
WHERE message_id IN (SELECT message_id FROM post WHERE term = (SELECT term FROM kw_freq WHERE r = 1))
  AND message_id NOT IN (SELECT message_id FROM post WHERE term = (SELECT term FROM kw_freq WHERE r = 2))"""))
def q_fts_not(spark, sf):
    ix = _index(spark, sf)
    freq, _ = _kw(ix)
    inc, exc = freq.filter("r = 1"), freq.filter("r = 2")
    return _ids(IX.join_back(_m(spark, sf), IX.match_not(ix, inc, exc)))


@register("fts_multifield", sql("""SELECT message_id FROM live WHERE message_id IN (
  SELECT message_id FROM post WHERE term IN (SELECT term FROM kw_rare)
  AND field IN ('subject', 'body', 'sender_email', 'sender_name'))"""))
def q_fts_multifield(spark, sf):
    ix = _index(spark, sf)
    _, rare = _kw(ix)
    return _ids(IX.join_back(_m(spark, sf), IX.match_any(ix, rare, IX.TEXT_FIELDS)))


PREFIX = "enth"


@register("fts_prefix", sql(f"""SELECT message_id FROM live WHERE message_id IN (
  SELECT message_id FROM post WHERE starts_with(term, '{PREFIX}'))"""))
def q_fts_prefix(spark, sf):
    return _ids(IX.join_back(_m(spark, sf), IX.match_prefix(_index(spark, sf), PREFIX)))


PHRASE_CTES = [
    """trigram AS (SELECT a.term AS t1, b.term AS t2, c.term AS t3, count(DISTINCT a.message_id) AS n
      FROM tok a JOIN tok b ON a.message_id = b.message_id AND a.field = b.field AND b.pos = a.pos + 1
      JOIN tok c ON a.message_id = c.message_id AND a.field = c.field AND c.pos = a.pos + 2
      WHERE a.field = 'body' GROUP BY 1, 2, 3)""",
    "phrase AS (SELECT t1, t2, t3 FROM trigram ORDER BY n DESC, t1, t2, t3 LIMIT 1)",
    """hit AS (SELECT DISTINCT a.message_id FROM tok a JOIN tok b
        ON a.message_id = b.message_id AND a.field = b.field AND b.pos = a.pos + 1
      JOIN tok c ON a.message_id = c.message_id AND a.field = c.field AND c.pos = a.pos + 2
      JOIN phrase ON a.term = t1 AND b.term = t2 AND c.term = t3)""",
]


@register("fts_phrase", sql("SELECT message_id FROM live WHERE message_id IN (SELECT message_id FROM hit)", *PHRASE_CTES))
def q_fts_phrase(spark, sf):
    m = _m(spark, sf)
    return _ids(IX.join_back(m, IX.match_phrase(_index(spark, sf), IX.top_phrase(m, 3))))


@register("fts_search_combined", sql(f"""SELECT message_id, size, count(*) OVER () AS total_count FROM live
WHERE message_id IN (SELECT message_id FROM hit)
  AND message_id IN (SELECT message_id FROM post WHERE starts_with(term, '{PREFIX}'))
  AND message_id IN (SELECT message_id FROM post WHERE term = (SELECT term FROM kw_freq WHERE r = 1))
  AND size BETWEEN 1000 AND 400000 AND is_read
ORDER BY size DESC, message_id LIMIT 10 OFFSET 3""", *PHRASE_CTES))
def q_fts_search_combined(spark, sf):
    return _searched(_m(spark, sf), _index(spark, sf))


def _searched(m, ix):
    query = S.build_query(filters=[dict(field="size", operator="between", value=[1000, 400000]),
                                   dict(field="is_read", operator="eq", value=True)],
                          sort_field="size", limit=10, offset=3)
    rows, hits = IX.search(m, ix, query, terms=_kw(ix)[0].filter("r = 1"), phrase=IX.top_phrase(m, 3), prefix=PREFIX)
    total = hits.select(F.count(F.lit(1))).scalar()
    return rows.select("message_id", "size", total.alias("total_count"))


@register("fts_bm25", sql("""SELECT message_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2
    / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
FROM q JOIN dft USING (term) JOIN dl USING (message_id) CROSS JOIN stats
GROUP BY message_id ORDER BY score DESC, message_id LIMIT 20""",
    "bp AS (SELECT * FROM post WHERE field = 'body' AND message_id IN (SELECT message_id FROM live))",
    "dl AS (SELECT message_id, sum(tf) AS dl FROM bp GROUP BY 1)",
    "stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)",
    "q AS (SELECT * FROM bp WHERE term IN (SELECT term FROM kw_freq UNION SELECT term FROM kw_rare))",
    "dft AS (SELECT term, count(*) AS df FROM q GROUP BY 1)"))
def q_fts_bm25(spark, sf):
    ix = _index(spark, sf)
    freq, rare = _kw(ix)
    return IX.bm25(ix, freq.select("term").unionByName(rare), "body", k=20)


@register("fts_segments_bm25", None)
def q_fts_segments_bm25(spark, sf):
    """D6 over seed and change sets: weights, lengths and flags of all of them."""
    ix = _segmented(spark, sf, False)
    freq, rare = _kw(ix)
    return IX.bm25(ix, freq.select("term").unionByName(rare), "body", k=20)


@register("fts_merged_bm25", None)
def q_fts_merged_bm25(spark, sf):
    """D6 after two merges."""
    ix = _segmented(spark, sf, True)
    freq, rare = _kw(ix)
    return IX.bm25(ix, freq.select("term").unionByName(rare), "body", k=20)


@register("fts_merged_search", None)
def q_fts_merged_search(spark, sf):
    """C26 after two merges: term, phrase, prefix and filters at once."""
    return _searched(_m(spark, sf), _segmented(spark, sf, True))


for _key, _same in (("fts_segments_bm25", "fts_bm25"), ("fts_merged_bm25", "fts_bm25"), ("fts_merged_search", "fts_search_combined")):
    ORACLES[_key] = ORACLES[_same]   # however the index came about


@register("fts_filtered", sql("SELECT message_id FROM live WHERE size BETWEEN 1000 AND 20000 AND NOT is_read"))
def q_fts_filtered(spark, sf):
    d = IX.index_document(_m(spark, sf))
    q = S.build_query(filters=[dict(field="size", operator="between", value=[1000, 20000]),
                               dict(field="is_read", operator="eq", value=False)])
    return _ids(S.matched(d, q))   # D8: no text → every document, then C26 filters


@register("fts_maintain", "WITH " + ", ".join([
    M, "ex AS (SELECT * FROM m WHERE event_id % 5 <> 0)",
    "nw AS (SELECT m.* REPLACE (concat('RE: ', coalesce(subject, '')) AS subject) FROM m WHERE event_id % 5 = 0)",
    "fin AS (SELECT * FROM ex UNION ALL SELECT * FROM nw)", *_index_ctes("fin")])
    + "\nSELECT term, field, message_id, tf FROM post")
def q_fts_maintain(spark, sf):
    ex, inc = fx.existing(spark, sf), fx.incoming(spark, sf)
    path = scratch_path(spark, "index")
    IX.store_index(ex, path)
    changed = ST.upsert(ST.matching(ex, inc), inc, fx.AS_OF)
    IX.replace(spark, path, changed, 1)
    return IX.load_index(spark, path).postings.select("term", "field", "message_id", "tf")


@register("index_document", "WITH " + M + """
SELECT message_id, coalesce(subject, '') AS subject, coalesce(body, '') AS body,
  coalesce(sender_email, '') AS sender_email, sender_name,
  concat_ws(' ', concat(to_email, ' '), CASE WHEN cc_email IS NOT NULL THEN concat(cc_email, ' ') END) AS recipients,
  array_to_string(list_filter([label_1, label_2, label_3], lambda x: x IS NOT NULL), ' ') AS labels,
  timestamp, size, is_read, is_outgoing, is_deleted FROM m""")
def q_index_document(spark, sf):
    return IX.index_document(_m(spark, sf))
