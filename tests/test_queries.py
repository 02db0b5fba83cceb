"""Every registered query against its SQL, whole tables of the smallest data; queries without SQL must run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TIEOUT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    try:
        return round(float(v), 9)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    rows = got.collect()
    if name not in ORACLE:
        assert got.columns
        return
    r = duck.sql(ORACLE[name])
    order = sorted(got.columns)
    assert order == sorted(r.columns)
    want = [dict(zip(r.columns, x)) for x in r.fetchall()]
    key = lambda t: [(v is None, str(type(v)), v if v is not None else 0) for v in t]
    assert sorted((tuple(plain(x[c]) for c in order) for x in rows), key=key) == sorted((tuple(plain(x[c]) for c in order) for x in want), key=key)


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(entry.queries())
