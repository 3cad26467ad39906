"""Every registered machining query against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from shopspark.plans.views import TABLES
from shopspark.queries import ENTRIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 9))
    return repr(v)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, duck, name):
    df = ENTRIES[name].build(spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if ENTRIES[name].sql is None:
        assert rows
        return
    got = duck.sql(ENTRIES[name].sql)
    assert sorted(got.columns) == cols
    at = [got.columns.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())
