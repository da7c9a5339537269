"""Every registered query against its SQL on DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from ledgerline.plans.catalog import ORACLE_SQL, QUERIES

from .conftest import FOLDER


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else v


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(([plain(v) for v in r] for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    found, expected = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
