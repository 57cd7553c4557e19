"""The driver's contract: every query with SQL gives that SQL's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from moraine.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(v):
    if isinstance(v, list):
        return tuple(map(norm, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert cols == sorted(names)
    assert sorted(repr([norm(r[c]) for c in cols]) for r in got.toArrow().to_pylist()) == sorted(repr([norm(r[c]) for c in cols]) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
