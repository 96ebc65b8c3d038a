"""Every registered query that has SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = {name: sql for p in __spark_entry__.PLANS for name, sql in p.SQL.items()}
QUERIES = {name: f for p in __spark_entry__.PLANS for name, f in p.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [got.columns.index(c) for c in want.columns]
    rows = [tuple(plain(r[i]) for i in order) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"k11_stream"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "kb_id", "chunk_id", "score", "rank"]
