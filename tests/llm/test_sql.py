"""Every query that has SQL against DuckDB, over whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

from trackweave.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((v is None, str(type(v)), v) for v in r)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)
