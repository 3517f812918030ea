"""Every registered query against its DuckDB twin, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from paperlode.plans.registry import ORACLE_SQL, QUERIES
from paperlode.plans.views import TABLES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if key not in ORACLE_SQL:
        assert got
        return
    cur = duck.execute(ORACLE_SQL[key])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
