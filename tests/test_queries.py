"""Every registered query on the smallest tables; those with SQL against DuckDB."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__ as entry_module
import driver_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
duckdb = pytest.importorskip("duckdb")

# the corpus queries have tests of their own
QUERIES = {k: v for k, v in entry_module.queries().items() if k in driver_queries.QUERIES}
ORACLE = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.date()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, rows) == table(columns, result.fetchall())


def test_oracle_keys_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
