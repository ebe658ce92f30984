"""The training-data queries that SQL can express agree with DuckDB on the smallest tables."""

import duckdb
import pytest

from rillflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{small}/documents.parquet'")
    said = duck.execute(ORACLES[name])
    names = [c[0] for c in said.description]
    got = QUERIES[name](spark, small)
    assert set(names) == set(got.columns)
    assert sorted(map(str, said.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
