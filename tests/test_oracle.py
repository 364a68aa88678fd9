"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sondage.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    return float(v) if type(v).__name__.startswith(("int", "float", "Decimal")) else str(v)


def _rows(df):
    names = sorted(df.columns)
    return sorted((tuple(map(_plain, r)) for r in df[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
