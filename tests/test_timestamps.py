import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from plotwright.operators.skew import lookup_join
from plotwright.operators.timestamps import build_dictionary, normalize_instants
from tests.fixtures import as_set, listing, rows

W = ZoneInfo("Europe/Warsaw")


def ms(*a, tz=W, us=0):
    return int(dt.datetime(*a, tzinfo=tz).timestamp()) * 1000 + us // 1000


UTC = dt.UTC
CASES = {
    "2024-01-03 01:45:12": ms(2024, 1, 3, 1, 45, 12),
    "20240103010803": ms(2024, 1, 3, 1, 8, 3),
    "20240103T095450Z": ms(2024, 1, 3, 9, 54, 50, tz=UTC),
    "Fri, 05 Jan 2024 03:27:32 +0300": ms(2024, 1, 5, 0, 27, 32, tz=UTC),
    "Thu, 04 Jan 2024 17:21:19 -0500": ms(2024, 1, 4, 22, 21, 19, tz=UTC),
    "2024-01-09T15:08:40+01:00": ms(2024, 1, 9, 14, 8, 40, tz=UTC),
    "09.01.2024 21:22": ms(2024, 1, 9, 21, 22),
    "2024-01-08": ms(2024, 1, 8),
    "2024-01-12 03:00:49 CET": ms(2024, 1, 12, 2, 0, 49, tz=UTC),
    "2024-07-12 03:00:49 CEST": ms(2024, 7, 12, 1, 0, 49, tz=UTC),
    "07.01.2024, godz. 22:49": ms(2024, 1, 7, 22, 49),
    "1704298168516": 1704298168516,
    "1704882094": 1704882094000,
    "15:44 08.01.24": ms(2024, 1, 8, 15, 44),
    "2024-01-03T15:44:46.707999Z": ms(2024, 1, 3, 15, 44, 46, tz=UTC, us=707999),
    "08/01/2024 07:25 PM": ms(2024, 1, 8, 19, 25),
    "08/01/2024 12:25 AM": ms(2024, 1, 8, 0, 25),
    "2024-01-13T05:38:36+01:00[Europe/Warsaw]": ms(2024, 1, 13, 4, 38, 36, tz=UTC),
    "2024-01-16 21:27:28,511": ms(2024, 1, 16, 21, 27, 28, us=511000),
    "06-01-2024 20:54:04 UTC": ms(2024, 1, 6, 20, 54, 4, tz=UTC),
    "2024.01.07": ms(2024, 1, 7),
    "Dodano: 12 STYCZNIA 2024 r.": ms(2024, 1, 12),
    "2024-01-06 19:00+01": ms(2024, 1, 6, 18, 0, tz=UTC),
    "10 sty 2024 09:43:27": ms(2024, 1, 10, 9, 43, 27),
    " \t26 stycznia 2024, 09:46 ": ms(2024, 1, 26, 9, 46),
    "5 paź 2024 08:00:00": ms(2024, 10, 5, 8),
    # The hour that occurs twice is the first one, the skipped one takes the offset before the change.
    "2024-10-27 02:30:00": ms(2024, 10, 27, 0, 30, tz=UTC),
    "2024-03-31 02:30:00": ms(2024, 3, 31, 1, 30, tz=UTC),
    "29.02.2024 10:00": ms(2024, 2, 29, 10),
}
UNREADABLE = [None, "", "   ", "-", "wczoraj", "brak daty", "Invalid date", "2025-02-30", "31.04.2025 12:10", "2026-13-05 10:00", "2025-06-11T27:15:00", "0000-00-00", "2024-01-03 10:00 XYZ", "2024-01-08 and more " * 500]


def test_every_notation(spark):
    df = listing(spark, *({"source": "x", "created": c} for c in CASES))
    got = {r["created"]: r["created_ms"] for r in normalize_instants(df).collect()}
    assert got == CASES


def test_unreadable_values_have_no_instant(spark):
    df = listing(spark, *({"source": "x", "created": c} for c in UNREADABLE))
    assert normalize_instants(df).count() == 0


def test_repeats_null_sources_and_clashing_columns(spark):
    df = rows(spark, "seq bigint, source string, created string, created_ms string, value int", *({"seq": i, "source": s, "created": "2024-01-08", "created_ms": "old", "value": i} for i, s in enumerate([None, None, "a", "a"])))
    got = normalize_instants(df)
    assert got.count() == 4 and got.columns == df.columns
    assert {r["created_ms"] for r in got.collect()} == {CASES["2024-01-08"]}


def test_zone_of_a_source(spark):
    df = listing(spark, {"source": "a", "created": "2024-01-08 10:00"}, {"source": "b", "created": "2024-01-08 10:00"})
    got = {r["source"]: r["created_ms"] for r in normalize_instants(df, zones={"b": "America/New_York"}).collect()}
    assert got == {"a": ms(2024, 1, 8, 9, tz=UTC), "b": ms(2024, 1, 8, 15, tz=UTC)}


def test_dictionary_grows_incrementally(spark, tmp_path):
    path = f"file://{tmp_path}/dict"
    first = listing(spark, {"source": "a", "created": "2024-01-08"})
    both = listing(spark, {"source": "a", "created": "2024-01-08"}, {"source": "a", "created": "2024-01-09"})
    build_dictionary(first, path=path)
    before = spark.read.parquet(path).inputFiles()
    assert build_dictionary(both, path=path).count() == 2
    assert set(before) < set(spark.read.parquet(path).inputFiles())
    assert normalize_instants(both, path=path).count() == 2
    assert spark.read.parquet(path).count() == 2


def test_empty_table(spark):
    assert normalize_instants(listing(spark)).count() == 0


@pytest.mark.parametrize("hot", [10**9, 2])
def test_lookup_join_keeps_every_row(spark, hot, monkeypatch):
    monkeypatch.setattr("plotwright.operators.skew.HOT_MIN_ROWS", hot)
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(40)] + [(99, None)], "i int, k string")
    right = left.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "upper(k) as up")
    got = lookup_join(left, right, ["k"], "n", ["up"])
    assert as_set(got.select("i", "up")) == {(i, "HOT" if i % 2 else f"K{i}") for i in range(40)}


def test_workers_get_the_package(spark, tmp_path):
    from plotwright.session import ship_code, work_dir

    ship_code(spark)
    ship_code(spark)  # once per application

    def run(batches):
        import plotwright.functions.text as t

        for b in batches:
            yield b.append_column("f", [t.fold_py("Ł")])

    assert [tuple(r) for r in spark.range(1).mapInArrow(run, "id bigint, f string").collect()] == [(0, "l")]
    assert spark.read.format("binaryFile").load(f"{work_dir(spark)}/plotwright.zip").count() == 1
