"""Every query against its DuckDB oracle on the smallest tables, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    if name in catalogue.ORACLES:
        found = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(repr([r[i] for i in at]) for r in found.fetchall())
