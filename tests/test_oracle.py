"""Every registered query beside its SQL twin in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sqltwins.sql import build_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
TWINS = build_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False)]
    return sorted(rows, key=str)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
    assert set(TWINS) <= set(entry.oracle_sql()) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(TWINS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
