"""Every query of the catalog against its DuckDB SQL."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from trackweave.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(repr(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
