import datetime as dt
import random
import time

from pyspark.sql import functions as F

from plotwright.functions.addresses import streets_agree
from plotwright.operators import deeds as D
from plotwright.plans.standins import QUERIES
from tests.fixtures import as_set, rows

RECORD = "record_id bigint, type string, area double, locality string, district string, street string, nr string, dzialka_id string, rooms int, floor_no int, plot_area double, first_seen date, delisted date"
DEED = "kind string, d date, c bigint, a double, izb int, kond int, grunt double, rynek string, msc string, ul string, nr string, dz string"
DAY = dt.date(2024, 6, 1)
REC = {"record_id": 1, "type": "flat", "area": 39.4, "locality": "Miasto", "street": "ul. Krótka", "first_seen": DAY, "delisted": dt.date(2024, 7, 1)}
SALE = {"kind": "flat", "d": dt.date(2024, 7, 10), "c": 400_000, "a": 39.4, "msc": "MIASTO", "ul": "Krótka"}


def matched(spark, record, *deeds):
    got = D.match_deeds(rows(spark, RECORD, REC | record), rows(spark, DEED, *(SALE | d for d in deeds)))
    return sorted((r["kind"], str(r["d"]), r["score"]) for r in got.collect())


def test_streets_numbers_and_parcels(spark):
    assert matched(spark, {}, {}) == [("sold", "2024-07-10", 2)]
    assert matched(spark, {"nr": "3a"}, {"nr": "3A"}) == [("sold", "2024-07-10", 2)]
    assert matched(spark, {"nr": "3"}, {"nr": "4"}) == []
    assert matched(spark, {}, {"ul": "Długa"}) == []
    assert matched(spark, {"dzialka_id": "1_4.5"}, {"dz": "1_4.5", "ul": "Długa"}) == [("sold", "2024-07-10", 2)]
    assert matched(spark, {"dzialka_id": "1_4.5", "street": None}, {"dz": "1_4.6", "ul": None}) == []


def test_areas_rooms_and_uniqueness(spark):
    none = {"street": None}
    assert matched(spark, none, {"ul": None}) == [("sold", "2024-07-10", 1)]  # the only candidate of a fine area
    assert matched(spark, none | {"area": 40.0}, {"ul": None, "a": 40.0}) == []
    assert matched(spark, none | {"area": 40.0, "rooms": 2, "floor_no": 3}, {"ul": None, "a": 40.0, "izb": 2, "kond": 4}) == [("sold", "2024-07-10", 1)]
    assert matched(spark, none | {"rooms": 2}, {"ul": None, "izb": 3}) == []
    assert matched(spark, {"area": 40.0}, {"a": 39.4}) == []  # 0.6000000000000014 apart
    assert matched(spark, {"area": 40.0}, {"a": 39.41}) == [("sold", "2024-07-10", 2)]
    house = {"type": "house", "street": None, "plot_area": 1000.0}
    assert matched(spark, house, {"kind": "house", "ul": None, "grunt": 1100.0}) == [("sold", "2024-07-10", 1)]
    assert matched(spark, house, {"kind": "house", "ul": None, "grunt": 1200.0}) == []


def test_windows_and_ambiguity(spark):
    day = lambda *a: {"d": dt.date(*a)}
    assert matched(spark, {}, {}, {"c": 500_000}) == []  # two best sales: ambiguous
    past = [day(2020, 1, k) for k in (1, 2, 3)]
    assert [k for k, *_ in matched(spark, {}, *past)] == ["past"] * 3
    assert matched(spark, {}, *past, day(2020, 1, 4)) == []
    assert matched(spark, {}, day(2024, 5, 20)) == [("past", "2024-05-20", 2)]  # in both windows
    assert matched(spark, {"first_seen": None, "delisted": None}, day(2024, 5, 20)) == [("past", "2024-05-20", 2)]
    assert matched(spark, {"locality": "Nieznane", "district": "Miasto"}, {}) == [("sold", "2024-07-10", 2)]


def test_funnel_and_search(spark):
    records = rows(spark, RECORD, REC, REC | {"record_id": 2, "locality": "X"}, REC | {"record_id": 3, "area": None}, REC | {"record_id": 4, "street": "Długa"}, REC | {"record_id": 5, "locality": " ", "district": None})
    deeds = rows(spark, DEED, SALE, SALE | {"kind": "house", "d": dt.date(2023, 1, 1)})
    assert as_set(D.match_funnel(records, deeds)) == {("matched", 1), ("no_location", 1), ("no_candidates", 2), ("rejected", 1)}
    assert [str(r["d"]) for r in D.search_deeds(deeds, "miasto", 39.0, street="krótkiej").collect()] in ([], ["2023-01-01", "2024-07-10"])
    assert D.search_deeds(deeds, "Miasto", 39.0, kind="flat").count() == 1 and D.search_deeds(deeds, "Miasto", 50.0).count() == 0


def test_pinned_deeds_developments_and_provenance(spark):
    pinned = {"nr": "3", "street": "Krótka"}
    assert matched(spark, pinned, {"a": None, "nr": "3"}) == [("sold", "2024-07-10", 2)]
    assert matched(spark, pinned, {"a": None, "nr": "4"}) == [] and matched(spark, {}, {"a": None, "nr": "3"}) == []
    assert matched(spark, {"dzialka_id": "7"}, {"a": None, "dz": "7", "ul": "Inna"}) == [("sold", "2024-07-10", 2)]
    new = rows(spark, RECORD + ", development boolean", REC | {"development": True}, REC | {"record_id": 2, "development": None})
    got = D.match_deeds(new, rows(spark, DEED, SALE | {"nr": "3", "rynek": "w", "dz": "1_2"})).collect()
    assert [(r["record_id"], r["confidence"], r["market"], r["addr"], r["dz"]) for r in got] == [(2, "high", "secondary", "Krótka 3", "1_2")]
    line = D.report(rows(spark, DEED, SALE | {"nr": "3"}), "Miasto", "flat", 39.4, "Krótka", "3").first()
    assert line["score"] == 2 and line["line"].startswith("high  2024-07-10  400000 zł  39.4 m2") and line["line"].endswith("Krótka 3")


def test_band_join_is_exact(spark):
    rng = random.Random(3)
    side = lambda n: [(i, rng.choice("ab"), rng.choice([None, *[rng.uniform(-50, 50) for _ in range(9)]])) for i in range(n)]
    left, right = side(150), side(150)
    got = D.band_candidates(spark.createDataFrame(left, "i int, k string, v double"), spark.createDataFrame(right, "j int, h string, w double"), [("k", "h")], ("v", "w"), 0.7)
    assert as_set(got.select("i", "j")) == {(i, j) for i, k, v in left for j, h, w in right if k == h and v is not None and w is not None and abs(v - w) <= 0.7}
    assert got.count() == got.distinct().count()
    open_ended = spark.range(1).select(D.within(F.lit(1), F.lit(None), F.lit(2)), D.within(F.lit(3), F.lit(None), F.lit(2)))
    assert tuple(open_ended.first()) == (True, False)


def test_same_streets_whatever_they_begin_with(spark, tmp_path):
    names = ["Krugłoszyckiego", "IDZIEGO KRUGŁOSZYCKIEGO", "T. Kruchowilewicza", "Kruchowilewicza", "prof. Ewarysta Dobrodziżawińskiego", "Dobrodziżawińskiego", "ul. Rynek", "Rynku", "Rynk", "Maja", "3 Maja", "Majowa", "Nad Maja", "ul.", "5", "", None, "Krótka", "Krótkiej", "Krótkie"]
    rows(spark, DEED, *(SALE | {"ul": u} for u in names)).write.parquet(f"{tmp_path}/deed.parquet")
    whole = spark.createDataFrame([(u,) for u in set(names) if u is not None], "ul string")
    want = as_set(whole.alias("x").crossJoin(whole.alias("y")).filter("x.ul < y.ul").filter(streets_agree(F.col("x.ul"), F.col("y.ul"))))
    assert as_set(QUERIES["q_same_streets"](spark, str(tmp_path))) == want
    assert {("IDZIEGO KRUGŁOSZYCKIEGO", "Krugłoszyckiego"), ("Kruchowilewicza", "T. Kruchowilewicza"), ("Dobrodziżawińskiego", "prof. Ewarysta Dobrodziżawińskiego"), ("3 Maja", "Maja")} <= want


def test_scores_by_rule_are_those_of_all_candidates(spark):
    rng = random.Random(5)
    pick = lambda *v: rng.choice(v)
    area = lambda: pick(None, 30.0, 30.6, 31.2, 30.3, 36.01, 40.0, *[round(rng.uniform(29, 90), 2) for _ in range(12)])
    street = lambda: pick(None, None, "", "Krótka", "ul. Krótkiej", "Nowa", "3 Maja", "Maja", "Jana Krótkiego", "--")
    shared = lambda: {"street": street(), "ul": street(), "nr": pick(None, "", "3", "3A", "3a", "4"), "dz": pick(None, None, "1_4.5", "1-4-5", "7")}
    rec = [shared() | {"record_id": i + (i == 7), "type": pick("flat", "house"), "area": area(), "locality": pick("A", "B", "C", ""), "district": pick(None, "B"), "rooms": pick(None, 1, 2), "floor_no": pick(None, 0, 1), "plot_area": pick(None, 0.0, 900.0, 1000.0), "first_seen": pick(None, DAY), "delisted": pick(None, DAY)} for i in range(250)]
    sold = [shared() | {"kind": pick("flat", "house"), "a": area(), "msc": pick("a", "b", "D", " "), "izb": pick(None, 1, 2), "kond": pick(None, 1, 2), "grunt": pick(None, 0.0, 900.0, 990.0, 1000.0, 1100.0), "d": DAY, "c": pick(1, 2)} for _ in range(250)]
    sold += sold[:40]
    records, deeds = rows(spark, RECORD, *[r | {"dzialka_id": r["dz"]} for r in rec]), rows(spark, DEED, *sold)
    c = D.deed_candidates(records, deeds)
    n = c.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("only"))
    names = ["record_id", "d", "c", "a", "score", "rynek", "ul", "deed_nr", "dz"]
    want = c.join(n.select("record_id", "n"), "record_id").withColumn("score", D.deed_score(F.col("n") == 1)).filter("score > 0").select(names)
    left, right = D._sides(records, deeds)
    counts = D._candidate_counts(left, right, 0.6)
    assert {(r["record_id"], r["several"], None if r["several"] else r["sole"]) for r in counts.collect()} == {(r["record_id"], r["n"] > 1, r["only"] if r["n"] == 1 else None) for r in n.collect()}
    got = D._scored(left, right, counts, 0.6).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(names)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and {r[0] for r in got.select("score").distinct().collect()} == {1, 2}


def test_a_crowded_band_is_not_paired_out(spark):
    one = {"type": "flat", "area": 39.4, "locality": "Miasto", "first_seen": DAY}
    records = spark.range(20_000).select(*[F.lit(v).alias(k) for k, v in one.items()], F.col("id").alias("record_id"), F.concat(F.lit("Aleja "), F.chr(97 + F.col("id") % 26), F.lit("ulna")).alias("street"), F.col("id").cast("string").alias("nr"), *[F.lit(None).cast(t).alias(k) for k, t in (("district", "string"), ("dzialka_id", "string"), ("rooms", "int"), ("floor_no", "int"), ("plot_area", "double"), ("delisted", "date"))])
    deeds = records.select(F.col("type").alias("kind"), F.date_sub("first_seen", 90).alias("d"), F.lit(400_000).cast("bigint").alias("c"), F.lit(39.4).alias("a"), *[F.lit(None).cast(t).alias(k) for k, t in (("izb", "int"), ("kond", "int"), ("grunt", "double"), ("rynek", "string"), ("dz", "string"))], F.col("locality").alias("msc"), F.col("street").alias("ul"), "nr")
    counted = time.time()
    assert D.match_deeds(records, deeds).count() == 20_000  # 400 million pairs of equal area
    assert time.time() - counted < 120


def test_funnel_counts_candidates_without_pairs(spark):
    few = {"type": "flat", "locality": "Miasto", "district": None, "street": None}
    records = spark.range(30_000).select(F.col("id").alias("record_id"), *[F.lit(v).cast("string").alias(k) for k, v in few.items()], F.when(F.col("id") < 5, 90.0).otherwise(40.0).alias("area"), *[F.lit(None).cast(t).alias(k) for k, t in (("nr", "string"), ("dzialka_id", "string"), ("rooms", "int"), ("floor_no", "int"), ("plot_area", "double"), ("first_seen", "date"), ("delisted", "date"))])
    deeds = rows(spark, DEED, SALE | {"ul": None, "a": 39.4}).withColumn("c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(30_000).cast("bigint")))).withColumn("a", F.lit(40.0))
    began = time.time()
    assert as_set(D.match_funnel(records, deeds)) == {("no_candidates", 5), ("rejected", 29_995)}  # 900 million candidates
    assert time.time() - began < 120


def test_archived_records_with_rooms_only_are_not_paired_out(spark):
    """As q_match_deeds reads them: no number, parcel or storey, and mostly no street."""
    records = spark.range(20_000).select(F.col("id").alias("record_id"), *[F.lit(v).cast("string").alias(k) for k, v in (("type", "flat"), ("locality", "Miasto"), ("district", None), ("street", ""), ("nr", None), ("dzialka_id", None))], F.when(F.col("id") == 0, 70.3).otherwise(40.3).alias("area"), F.lit(2).alias("rooms"), F.lit(None).cast("int").alias("floor_no"), F.lit(None).cast("double").alias("plot_area"), F.lit(DAY).alias("first_seen"), F.lit(None).cast("date").alias("delisted"))
    deeds = rows(spark, DEED, SALE | {"d": dt.date(2024, 1, 1), "izb": 2}).withColumn("c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20_000).cast("bigint")))).withColumn("a", F.when(F.col("c") == 7, 70.25).otherwise(40.5))
    began = time.time()
    assert [(r["record_id"], r["kind"], r["price"], r["score"]) for r in D.match_deeds(records, deeds).collect()] == [(0, "past", 7, 1)]
    assert time.time() - began < 120


def test_rules_that_no_record_tells_enough_for_do_not_read_the_deeds(spark):
    """Archived records tell no number, parcel, storey or plot: deeds are read for streets and sole candidates only."""
    deeds = rows(spark, DEED, SALE | {"nr": "3", "dz": "1_4.5", "izb": 2, "kond": 1}, SALE | {"ul": "Długa", "nr": "4", "dz": "7"}, SALE | {"msc": " "})

    def scored(**record):
        left, right = D._sides(rows(spark, RECORD, REC | record), deeds)
        got = D._scored(left, right, D._candidate_counts(left, right, 0.6), 0.6)
        joins = got._jdf.queryExecution().analyzed().toString().count("Join Inner")
        return joins, [tuple(r) for r in got.select("score", "ul", "deed_nr", "dz").collect()], right.filter("d_nr is not null or d_dz is not null").count()

    best = (2, "Krótka", "3", "1_4.5")
    assert scored() == (2, [best], 0)
    assert scored(nr="3") == (3, [best], 2)
    assert scored(dzialka_id="1_4.5", street="Inna") == (3, [best], 2)
    assert scored(rooms=2, floor_no=0, street=None)[:2] == (3, [(1, "Krótka", "3", "1_4.5")])
