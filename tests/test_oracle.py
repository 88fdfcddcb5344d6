"""Every registered query against its DuckDB twin at sf0.001."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from eventscope.plans.catalog import QUERIES
from eventscope.plans.streams import STREAM_QUERIES

TABLES = ["events", "part"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    missing = {*QUERIES, *STREAM_QUERIES} - set(oracle_sql())
    assert not missing, missing


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["category", "count"]


@pytest.mark.parametrize("name", sorted({*QUERIES, *STREAM_QUERIES}))
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = queries()[name](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(df.columns, srows) == _canon(dcols, drows)
