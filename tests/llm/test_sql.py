"""Queries that SQL can express, compared with DuckDB value by value."""

import duckdb
import pytest

from gridseries.llm import queries

from helpers import SF001

TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    res = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in res.description]
    df = queries.QUERIES[name](spark, SF001)
    assert sorted(df.columns) == sorted(cols)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(str, res.fetchall()))
    assert got
