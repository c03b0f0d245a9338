import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotwright.operators import views as V
from plotwright.streaming.observe import SCHEMA, distinct_sightings, observe, run_available
from tests.fixtures import as_set, rows

CARD = "seq bigint, type string, price bigint, area double, rooms int, locality string, district string, title string, created string, sources array<string>, is_private boolean, relisted boolean, development boolean, price_history array<bigint>, distance_km bigint, price_per_m2 double, discount_pct double, sales array<struct<kind:string,price:bigint>>"


def cards(spark):
    return rows(
        spark, CARD,
        {"seq": 1, "type": "flat", "price": 300, "area": 40.0, "rooms": 2, "locality": "A", "title": "Taras", "created": "2024-02", "sources": ["x"], "is_private": True, "price_history": [400, None, 300], "distance_km": 5, "sales": [("past", 9)]},
        {"seq": 2, "type": "house", "price": None, "locality": "B", "sources": ["x", "y"], "development": True, "relisted": True, "price_history": [300, 400]},
        {"seq": 3, "type": "flat", "price": 500, "area": 60.0, "rooms": None, "locality": "A", "created": "2024-03", "sources": ["y"], "is_private": False, "distance_km": 50},
    )


def hits(spark, **q):
    return [r["seq"] for r in V.run_query(cards(spark), V.CardQuery(**q)).collect()]


def test_filters_and_orders(spark):
    assert hits(spark) == [3, 1, 2] and hits(spark, sort="price_asc") == [1, 3, 2] and hits(spark, sort="area_desc") == [3, 1, 2]
    assert hits(spark, type="house") == [2] and hits(spark, source="y") == [3, 2] and hits(spark, owner="private") == [1] and hits(spark, owner="agency") == [3]
    assert hits(spark, market="primary") == [2] and hits(spark, history="relisted") == [2] and hits(spark, history="dropped") == [1] and hits(spark, history="rcn") == [1]
    assert hits(spark, localities=("A",)) == [3, 1] and hits(spark, min_rooms=1) == [1] and hits(spark, distance=10) == [1] and hits(spark, max_price="400") == [1]
    assert hits(spark, min_price="abc") == [3, 1, 2] and hits(spark, q=" TARAS ") == [1]


def test_archive_towns_numbers_and_missing_columns(spark):
    gone = rows(spark, "archive_id bigint, type string, price bigint, locality string, delisted date, sold string", {"archive_id": 1, "type": "flat", "price": 5, "delisted": dt.date(2024, 1, 1)}, {"archive_id": 2, "type": "flat", "price": 9, "delisted": dt.date(2024, 2, 1), "sold": "x"}, {"archive_id": 3, "type": "house", "delisted": None})
    read = []
    ids = lambda **q: [r["archive_id"] for r in V.run_query(cards(spark), V.CardQuery(**q), lambda: read.append(1) or gone).collect()]
    assert hits(spark) == [3, 1, 2] and not read
    assert ids(history="sold") == [2, 1, 3] and ids(history="sold_rcn") == [2] and read
    assert ids(history="sold", owner="private", sort="price_asc") == [1, 2, 3] and ids(history="sold", market="primary") == []
    with pytest.raises(ValueError):
        V.run_query(cards(spark), V.CardQuery(history="sold"))
    with pytest.raises(ValueError):
        V.run_query(cards(spark).drop("rooms"), V.CardQuery(min_rooms=2))
    assert [V.CardQuery(min_price=x).number("min_price") for x in ("12 tys", " 1e3", "-4.5x", "abc", "", None, float("inf"), ".5", True)] == [12, 1000, -4.5, None, None, None, None, 0.5, None]
    assert [r["seq"] for r in V.run_query(cards(spark), V.CardQuery(localities=("B",)), city_of={"A": "B"}).collect()] == [3, 1, 2]
    places = rows(spark, "town string, lat double, lon double", {"town": "B", "lat": 50.0, "lon": 19.0}, {"town": "B", "lat": 50.0, "lon": 19.0}, {"town": "A", "lat": 51.0, "lon": 19.0})
    far = V.with_distance(cards(spark).drop("distance_km"), places, (50.0, 19.0))
    assert {r["seq"]: r["distance_km"] for r in far.collect()} == {1: 111, 2: 0, 3: 111}
    named = rows(spark, "locality string", {"locality": "Żory"}, {"locality": "Łódź"}, {"locality": "Lublin"}, {"locality": ""}, {"locality": "Zabrze"})
    assert [r["value"] for r in V.facets(named, "locality", {}, "pl").collect()] == ["Lublin", "Łódź", "Zabrze", "Żory"]


def test_queries_travel_as_json():
    q = V.CardQuery(type="flat", min_price="10", localities=("A", "B"), sort="price_asc")
    assert V.CardQuery.from_json(q.to_json()) == q
    assert V.CardQuery.from_json('{"type": "castle", "sort": 5, "minArea": 3, "other": 1}') == V.CardQuery(min_area=3)
    assert V.CardQuery.from_json("{broken") == V.CardQuery() == V.CardQuery.from_json("[1]")
    assert q.active() == {"type": "flat", "min_price": "10", "localities": ("A", "B")}
    assert q.reset("type").type == "all" and q.reset() == V.CardQuery(sort="price_asc")


def test_facets_pages_and_labels(spark):
    df = cards(spark)
    assert [tuple(r) for r in V.facets(df, "sources").collect()] == [("x", 2), ("y", 2)]
    assert [r["seq"] for r in V.page(df.orderBy("seq"), 1, 2).collect()] == [3]
    pct, off = V.discount(F.lit(15_000), F.lit(20_000))
    low, _ = V.discount(F.lit(5_000), F.lit(20_000))
    assert tuple(spark.range(1).select(pct, off, low).first()) == (25.0, 5_000, 0.0)
    got = df.select(V.price_label(F.lit(1), F.lit(2)), V.price_label(F.lit(1), F.lit(1)), V.last_past_sale(F.col("sales"))["price"]).first()
    assert tuple(got) == ("1 - 2", "1", 9)
    assert V.summary(df.withColumn("archived", F.lit(None).cast("boolean"))).first()["rows"] == 3


def test_streams(spark, tmp_path):
    ev = [(1, 7, "a", 5), (2, 7, "a", 6), (3, 7, "b", 7), (4, 8, "a", 30), (5, 7, "a", 31)]
    df = spark.createDataFrame([(i, u, t, h) for i, u, t, h in ev], "event_id bigint, user_id bigint, event_type string, h int").selectExpr("event_id", "timestamp_seconds(1704067200 + h * 3600) ts", "user_id", "event_type", "0D value", "'' props")
    path = f"{tmp_path}/in"
    df.write.parquet(f"{path}/one.parquet")
    want = as_set(observe(df))
    assert len(want) == 4 and as_set(run_available(spark, f"file://{path}/one.parquet")) == want
    out = distinct_sightings(spark.readStream.schema(SCHEMA).parquet(f"file://{path}/one.parquet"), "1 day")
    q = out.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 3
