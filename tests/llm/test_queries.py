"""The training-data queries against their SQL on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plotwright.llm.queries import QUERIES
from plotwright.llm.sql import ORACLE

DIR = os.environ.get("PLOTWRIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

COLUMNS = {
    "p2_found": "source string, source_id string, group_seq bigint", "p3_found": "seq_a bigint, seq_b bigint", "p4_found": "seq bigint, loc_id bigint", "p5_found": "seq_a bigint, seq_b bigint", "p6_found": "archive_id bigint, deed_id bigint",
    "p7_found": "group_id bigint, seq bigint, price bigint, source string, created_ms bigint", "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint, kind string, start_pos bigint",
}


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        assert len(rows) == len(set(rows)), "each row occurs once"
    if name in ORACLE:
        c = duckdb.connect()
        for f in os.listdir(DIR):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
        got = c.sql(ORACLE[name])
        at = [got.columns.index(x) for x in df.columns]
        assert sorted(map(tuple, rows), key=repr) == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)
