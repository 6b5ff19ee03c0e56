"""Every registered query runs; those with a SQL twin give the same rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        return
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
