"""Shared SQL fragments for oracles (DuckDB dialect).

``M`` is the flat ``messages`` fixture of FIXTURES.md section 3.1; oracle
queries start with ``WITH m AS (...)``. Spark never runs these strings.
"""

M_SELECT = """
SELECT e.event_id,
  concat('m', e.event_id) AS message_id,
  CASE WHEN e.event_id % 10 = 0 THEN concat('s', e.event_id)
       WHEN e.event_id % 10 < 4 THEN concat('t', CAST(floor(e.event_id / 10.0) AS BIGINT))
       ELSE concat('l', CAST(floor(e.event_id / 40.0) AS BIGINT)) END AS thread_id,
  CASE WHEN e.event_id % 97 = 0 THEN '' WHEN e.event_id % 89 = 0 THEN NULL
       ELSE concat('User', e.user_id, '@mail', e.user_id % 5, '.example.com') END AS sender_email,
  concat('User ', e.user_id, ' v', e.event_id % 3) AS sender_name,
  concat('user', (e.user_id + 1) % 50, '@mail0.example.com') AS to_email,
  CASE WHEN e.event_id % 3 = 0 THEN concat('user', (e.user_id + 7) % 50, '@mail1.example.com') END AS cc_email,
  upper(e.event_type) AS label_1,
  CASE WHEN e.value > 250 THEN 'IMPORTANT' ELSE 'CATEGORY_UPDATES' END AS label_2,
  CASE WHEN e.event_type = 'error' THEN 'UNREAD' END AS label_3,
  CASE WHEN e.event_id % 61 = 0 THEN NULL ELSE substr(d.text, 1, 60) END AS subject,
  CASE WHEN e.event_id % 67 = 0 THEN NULL ELSE d.text END AS body,
  CAST(floor(e.value * e.value * 8) AS BIGINT) AS size,
  e.ts AS timestamp,
  e.event_type <> 'error' AS is_read,
  e.event_type IN ('purchase', 'signup') AS is_outgoing,
  e.event_id % 50 = 7 AS is_deleted,
  e.event_type
FROM events e LEFT JOIN documents d
  ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
"""

M = f"m AS ({M_SELECT}), live AS (SELECT * FROM m WHERE NOT is_deleted)"

LABELS = "list_filter([label_1, label_2, label_3], lambda x: x IS NOT NULL)"

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
AS_OF_ORDERS = "TIMESTAMP '2001-09-01 00:00:00'"

ORDERS_TL = """ot AS (SELECT concat('o', o_orderkey) AS message_id, o_orderdate AS timestamp,
  CAST(floor(o_totalprice) AS BIGINT) AS size, false AS is_deleted FROM orders)"""


def with_m(body: str, *extra_ctes: str) -> str:
    ctes = ", ".join([M, *extra_ctes])
    return f"WITH {ctes}\n{body}"

# Markup of the oracle, written out on its own: comments, blocks, tags, declarations.
HTML_MARKUP = ["(?is)<!--.*?-->", "(?is)<script\\b[^>]*>.*?</script>", "(?is)<style\\b[^>]*>.*?</style>",
               "(?is)<template\\b[^>]*>.*?</template>", "(?i)</?[a-z][^>]*>", "<[!?][^>]*>"]
# Character references that the input tables hold.
HTML_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "\u00a9"),
                   ("&middot;", "\u00b7"), ("&amp;", "&")]


def html_text(expr: str) -> str:
    """Text of a body: markup removed kind by kind, then the references of the tables."""
    s = expr
    for p in HTML_MARKUP:
        s = f"regexp_replace({s}, '{p}', '', 'g')"
    for a, b in HTML_REFERENCES:
        s = f"replace({s}, '{a}', '{b}')"
    return s


LABEL_ID = ("CASE event_type WHEN 'click' THEN 'L0' WHEN 'error' THEN 'L1' WHEN 'purchase' THEN 'L2' "
            "WHEN 'signup' THEN 'L3' WHEN 'view' THEN 'L4' END")
