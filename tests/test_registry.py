"""Every registered query against its SQL oracle on the smallest input."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as se
from gridseries.plans.oracle import ORACLE
from gridseries.plans.registry import QUERIES
from tests.conftest import SF001

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "region", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) <= set(se.queries())
    assert set(se.oracle_sql()) <= set(se.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    oi = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(_norm(r[i]) for i in oi) for r in rel.fetchall()), key=repr)
    assert a == b


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["cell_row", "cell_col", "mean_v"]
    assert df.count() == 64
