"""Registered queries: one per operator, and those with SQL against DuckDB."""
import duckdb
import pytest

import __spark_entry__
from eventscope.llm.queries import LLM_ORACLE, LLM_QUERIES

TABLES = ["documents", "pages", "benchmark", "conversations", "labels"]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert {*LLM_QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, sf_small)
    want = con.execute(LLM_ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    rows = [dict(zip([d[0] for d in want.description], r)) for r in want.fetchall()]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[c] for c in columns]) for r in rows)
