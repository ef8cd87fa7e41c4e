"""Every registered query against its DuckDB oracle on sf0.001 (row count,
column names, order-insensitive value hash), the driver's check in small."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402
from mailweave.sources.tables import TABLES  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    r = df.collect()
    assert len(r) == 1 and r[0]["total_messages"] == 980 and r[0]["total_sent"] == 388
    assert r[0]["total_unread"] == 199 and r[0]["total_size_bytes"] == 36756268


def test_every_query_has_callable():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    drows = [tuple(r[dcols.index(c)] for c in df.columns) for r in cur.fetchall()]
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(df.columns, drows)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() >= 0
