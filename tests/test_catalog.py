"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
