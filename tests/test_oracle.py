"""Every registered query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from palisade.sources.tables import BASE

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cur = con.cursor().execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, want)


def test_queries_without_twin_give_rows(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf).count() > 0, name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["section", "item", "detail", "n"]
    assert df.count() > 0
