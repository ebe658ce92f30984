"""The contract: every query runs on the small tables, those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from rillflow.plans import catalogue


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    got = contract.queries()[name](spark, small).toPandas()
    if name not in contract.oracle_sql():
        assert len(got)
        return
    want = duck.execute(contract.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert (a[c].astype(str) == b[c].astype(str)).all() or (a[c] == b[c]).all(), c


def test_entry(spark):
    assert contract.entry(spark).count() > 0
