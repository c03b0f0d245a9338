"""Registered queries against their SQL on the smallest tables, where these are there."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("PLOTWRIGHT_TESTDATA", "/root/testdata/sf0.001")
CORE = [n for n in entry.queries() if n.startswith("q_") or n == "p1_found"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_agrees_with_sql(spark, sql, name):
    df = entry.queries()[name](spark, DIR)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in entry.oracle_sql():
        assert rows
        return
    got = sql.sql(entry.oracle_sql()[name])
    assert cols == sorted(got.columns)
    at = [got.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
