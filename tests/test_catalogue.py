"""Queries against their SQL on the smallest test tables, where those are there."""

import glob
import os

import pytest

from framefold.plans import catalogue, details

DATA = "/root/testdata/sf0.001"
QUERIES = catalogue.queries() | details.queries()
SQL = catalogue.oracle_sql() | details.oracle_sql()


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({SQL[name]}) t").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want) and want


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
