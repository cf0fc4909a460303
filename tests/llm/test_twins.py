"""Queries of this package beside their SQL twins, as far as SQL can express them."""

import os

import duckdb
import pytest

from txnrisk.llm.queries import queries
from txnrisk.llm.sql import oracle_sql

FOLDER = "/root/testdata/sf0.001"
TWINS = oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(queries())


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got = queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = con.execute(TWINS[name])
    assert sorted(d[0] for d in found.description) == columns
    place = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(row[i] for i in place) for row in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == want
