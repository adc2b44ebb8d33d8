"""Every query with SQL gives what DuckDB gives on the smallest tables; the rest run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str(tuple(fix(r[k]) for k in order)) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        cur = duck.execute(SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(df.columns, got) == plain(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
