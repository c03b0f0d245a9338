import datetime as dt

from pyspark.sql import functions as F

from plotwright.functions.photos import limbs_of_decimal
from plotwright.operators import state as S
from plotwright.operators import views as V
from plotwright.sources.schemas import OBSERVATION
from tests.fixtures import as_set, rows

RECORD = "record_id bigint, record_ord bigint, type string, area double, hashes array<array<bigint>>, photo_urls array<string>, first_seen date, last_seen date, delisted date, development boolean, title string, image string, locality string, district string, street string, rooms int, floor string, plot_area double, url string, source string, price bigint"
CARD = "seq bigint, type string, area double, url string, price bigint, source string, phashes array<array<bigint>>, photo_urls array<string>, title string, image string, locality string, district string, street string, rooms int, floor string, plot_area double, development boolean"
H1, H2, FAR = limbs_of_decimal(3), limbs_of_decimal(5), limbs_of_decimal(2**64 - 1)
D = lambda n: dt.date(2024, 1, n)
DAY = lambda n: F.lit(D(n))


def day(spark, records, log, n, *cards):
    base = {"type": "flat", "area": 50.0, "source": "a", "price": 100}
    return S.update(records, log, rows(spark, CARD, *({"seq": i + 1, **base, **c} for i, c in enumerate(cards))), DAY(n))


def test_days_follow_each_other(spark):
    records, log, ids = day(spark, rows(spark, RECORD), rows(spark, OBSERVATION), 1, {"url": "u", "phashes": [H1], "title": "t"}, {"url": "v"}, {"url": "w", "phashes": [H2], "area": 50.4})
    assert len({r["record_id"] for r in ids.collect()}) == 2  # the third card shows a photo of the first
    assert as_set(log.select("url", "date")) == {("u", D(1)), ("v", D(1)), ("w", D(1))}
    records, log = records.withColumn("delisted", F.when(F.col("url") == "v", DAY(2))), log
    records, log, ids = day(spark, records, log, 3, {"url": "x", "phashes": [H2], "title": "", "rooms": 2}, {"url": "v", "price": 90}, {"url": "u", "phashes": [limbs_of_decimal(2**256 - 1)]})
    got = {r["record_id"]: r for r in records.collect()}
    assert len(got) == 3  # the recycled address with other photos is a new record
    first = next(r for r in got.values() if r["rooms"] == 2)
    assert first["title"] == "t" and first["first_seen"] == D(1) and first["last_seen"] == D(3) and first["hashes"] == [H1, H2]
    assert all(r["delisted"] is None for r in got.values()) and log.count() == 6


def test_archived_evidence(spark):
    records = rows(spark, RECORD, {"record_id": 1, "record_ord": 1, "type": "flat", "area": 50.0}, {"record_id": 2, "record_ord": 2, "type": "flat", "area": 50.0, "hashes": [H1]}, {"record_id": 3, "record_ord": 3})
    log = rows(spark, OBSERVATION, {"record_id": 1, "obs_seq": 1, "date": D(1), "url": "u"}, {"record_id": 3, "obs_seq": 1, "date": D(5), "url": "x"})
    closed = rows(spark, CARD, {"seq": 1, "url": "u"}, {"seq": 2, "url": "other", "type": "flat", "area": 50.0, "phashes": [H2]}, {"seq": 3, "url": "x"}, {"seq": 4, "url": "unknown"})
    got, seen = S.observe_archived(records, log, closed, DAY(5))
    assert as_set(got.select("record_id", "delisted")) == {(1, D(5)), (2, D(5)), (3, None)}
    assert as_set(seen.filter("status = 'archived'").select("record_id", "url")) == {(1, "u"), (2, "other")}


def test_sweep(spark):
    records = rows(spark, RECORD, {"record_id": 1}, {"record_id": 2, "delisted": D(1)}, {"record_id": 3, "delisted": D(1)}, {"record_id": 4, "development": True}, {"record_id": 5})
    log = rows(spark, OBSERVATION, *({"record_id": i, "obs_seq": 1, "date": D(n), "url": u} for i, n, u in ((1, 1, "a"), (2, 1, "b"), (3, 19, "c"), (4, 1, "d"), (5, 1, "e"))))
    active = spark.createDataFrame([("b",)], "url string")
    fetched = spark.createDataFrame([("a", True), ("d", True), ("e", None)], "url string, gone boolean")
    assert as_set(S.sweep(records, log, active, fetched, DAY(20)).select("record_id", "delisted")) == {(1, D(1)), (2, None), (3, None), (4, None), (5, None)}


def test_compaction(spark):
    records = rows(spark, RECORD, *({"record_id": i, "record_ord": i, "hashes": h, "first_seen": D(10 - i), "last_seen": D(i), "photo_urls": [f"p{i}"], "title": t} for i, h, t in ((1, None, "old"), (2, [H1], ""), (3, None, "x"), (4, [H1], None), (5, [FAR], None), (6, None, None))))
    log = rows(spark, OBSERVATION, *({"record_id": i, "obs_seq": n, "date": D(n), "url": u} for i, n, u in ((1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (3, 3, "b"), (4, 1, "c"), (5, 1, "c"), (6, 1, "z"))))
    got, seen = S.compact(records, log)
    kept = {r["record_id"]: r for r in got.collect()}
    assert set(kept) == {2, 4, 5, 6}
    assert (kept[2]["title"], kept[2]["first_seen"], kept[2]["last_seen"], kept[2]["photo_urls"]) == ("old", D(7), D(3), ["p2", "p1", "p3"])
    assert as_set(seen.filter("record_id = 2").select("date", "url")) == {(D(1), "a"), (D(2), "b"), (D(3), "b")}


def test_overrides_caches_and_late_joins(spark):
    records = rows(spark, RECORD, {"record_id": 1, "street": "s", "rooms": 1}, {"record_id": 2, "street": "t"})
    log = rows(spark, OBSERVATION, {"record_id": 1, "obs_seq": 1, "url": "u"})
    pins = spark.createDataFrame([("u", None, 3, "7"), ("nowhere", "x", 9, None)], "url string, street string, rooms int, nr string")
    assert as_set(S.apply_overrides(records, log, pins).select("record_id", "street", "rooms", "nr", "manual")) == {(1, "s", 3, "7", True), (2, "t", None, None, False)}
    cache = rows(spark, "url string, hashes array<string>, seen date, urls array<string>", {"url": "u", "hashes": ["1"]}, {"url": "v", "hashes": []})
    hit, missing = S.attach_hashes(spark.createDataFrame([("a", "u"), ("a", "v"), ("a", None)], "source string, url string"), cache)
    assert hit.filter("phashes is not null").count() == 1 and as_set(missing) == {("a", "v")}
    sale = "record_id bigint, price bigint"
    assert as_set(S.keep_sales(spark.createDataFrame([(1, 5), (2, 6)], sale), spark.createDataFrame([(2, 7)], sale))) == {(1, 5), (2, 7)}
    ids = spark.createDataFrame([(1, 9)], "seq bigint, record_id bigint")
    assert as_set(S.enrich(spark.createDataFrame([(1,), (2,)], "seq bigint"), ids, spark.createDataFrame([(9, "x")], "record_id bigint, t string")).select("seq", "t")) == {(1, "x"), (2, None)}
    places = spark.createDataFrame([("Miasto", "Krótka", "7a", 1.0, 2.0)], "town string, street string, number string, x double, y double")
    at = rows(spark, "locality string, street string, nr string", {"locality": "MIASTO", "street": "krótka", "nr": "7 A"}, {"locality": "Miasto", "street": "Krótka", "nr": "8"})
    assert as_set(S.locate(at, places).select("nr", "x", "y")) == {("7 A", 1.0, 2.0), ("8", None, None)}


def test_card_lines(spark):
    offers = "array<struct<source:string,price:bigint,url:string>>"
    df = rows(spark, f"offers {offers}, sales array<struct<kind:string,price:bigint>>", {"offers": [("a", 1, "u"), ("b", 2, "v")], "sales": [("past", 1), ("sold", 5)]})
    assert [tuple(o) for o in df.select(V.offer_lines(F.col("offers"), F.lit("u"))).first()[0]] == [("a", 1, True), ("b", 2, False)]
    none = F.lit(None).cast("array<int>")
    got = df.select(V.history_line(F.lit(True), F.lit(2.0), none, F.array(F.lit(1), F.lit(2)), F.lit(1)), V.banner(F.col("sales"), DAY(1)), V.banner(F.lit(None).cast("array<struct<kind:string,price:bigint>>"), DAY(1)), V.timeline_shown(none, none, F.col("sales"))).first()
    assert tuple(got) == (["relisted", "discount", "trail"], "sold 5", "gone 2024-01-01", True)
