"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from checks import ORACLES, QUERIES
from checks.compare import rows_of
from checks.registry import NAMES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{FOLDER}/{n}.parquet')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    assert got[0]
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        assert got == rows_of([c[0] for c in res.description], res.fetchall())
