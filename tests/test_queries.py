"""Every query with SQL gives DuckDB's rows; every other one runs."""

import os

import duckdb
import pandas as pd
import pytest

from sedgeline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def cell(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return ""
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        assert [tuple(c.removesuffix(".000000") for c in r) for r in rows(got)] == [tuple(c.removesuffix(".000000") for c in r) for r in rows(want)]
