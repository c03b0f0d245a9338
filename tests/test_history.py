import datetime as dt

from pyspark.sql import functions as F

from plotwright.functions.photos import limbs_of_decimal
from plotwright.operators import history as H
from plotwright.sources.schemas import OBSERVATION
from tests.fixtures import as_set, rows

D = lambda n: dt.date(2024, 1, n)
H1, H2, FAR = limbs_of_decimal(3), limbs_of_decimal(5), limbs_of_decimal(2**64 - 1)


def log(spark, *seen):
    return rows(spark, OBSERVATION, *({"record_id": 1, "obs_seq": i, "date": D(d), "price": p, "url": u, "source": "a", "status": s} for i, (d, p, u, s) in enumerate(seen)))


def test_timeline_order(spark):
    seen = log(spark, (1, 100, "a", None), (3, 90, "a", None), (5, 95, "b", None), (6, 95, "b", "archived"))
    delisted = spark.createDataFrame([(1, D(7))], "record_id bigint, delisted date")
    sales = rows(spark, "record_id bigint, sale_seq bigint, date date, price bigint, kind string", {"record_id": 1, "sale_seq": 1, "date": D(1), "price": 50, "kind": "past"}, {"record_id": 1, "sale_seq": 2, "date": D(9), "price": 80, "kind": "sold"})
    got = [r["kind"] for r in H.timelines(H.timeline_events(seen, delisted, sales)).orderBy("n").collect()]
    assert got == ["sale_past", "listed", "price", "relist", "archived", "delisted", "sale"]


def test_long_timelines_keep_both_ends(spark):
    seen = log(spark, *((1 + i, i, "a", None) for i in range(30)))
    got = [r["n"] for r in H.timelines(H.timeline_events(seen)).orderBy("n").collect()]
    assert got == [1, 2, *range(9, 31)]
    arr = spark.range(1).select(F.sequence(F.lit(1), F.lit(30)).alias("a")).select(H.cap_timeline(F.col("a"))).first()[0]
    assert arr == got


def test_trails_and_changes(spark):
    seen = log(spark, (1, 100, "a", None), (2, 100, "b", None), (3, None, "a", None), (4, 90, "a", None))
    assert [r["obs_seq"] for r in H.price_trail(seen).orderBy("obs_seq").collect()] == [0, 2, 3]
    assert as_set(H.url_price_changes(seen).select("obs_seq", "before")) == {(3, 100)}
    assert as_set(H.relisted_before(seen, F.lit(D(4))).select("record_id", "prev_price")) == {(1, 100)}
    assert as_set(H.last_sighting(log(spark, (2, 1, "a", None), (2, 2, "b", None))).select("url")) == {("a",)}


def test_append_once_a_day(spark):
    old = log(spark, (1, 100, "a", None))
    new = log(spark, (1, 90, "a", None), (2, 80, "a", None), (2, 70, "a", None))
    got = H.append_observations(old, new)
    assert as_set(got.select("obs_seq", "date", "price")) == {(0, D(1), 100), (1, D(2), 80)}


def test_cards_find_their_records(spark):
    rec = "record_id bigint, record_ord bigint, type string, area double, hashes array<array<bigint>>"
    records = rows(spark, rec, {"record_id": 1, "record_ord": 1, "type": "flat", "area": 50.0, "hashes": [H1]}, {"record_id": 2, "record_ord": 2, "type": "flat", "area": 49.0, "hashes": [H1]}, {"record_id": 3, "record_ord": 3, "type": "flat", "area": 90.0, "hashes": [FAR]})
    seen = rows(spark, OBSERVATION, {"record_id": 3, "obs_seq": 1, "url": "u"})
    card = "seq bigint, type string, area double, url string, phashes array<array<bigint>>, development boolean"
    cards = rows(spark, card, {"seq": 1, "type": "flat", "area": 50.4, "phashes": [H2]}, {"seq": 2, "type": "flat", "area": 50.4, "url": "u"}, {"seq": 3, "type": "flat", "area": 50.4, "url": "u", "phashes": [limbs_of_decimal(2**256 - 1)]}, {"seq": 4, "type": "flat", "area": 50.0, "url": "u", "phashes": [H1], "development": True}, {"seq": 5, "type": "house", "area": 50.0, "phashes": [H1]})
    assert as_set(H.match_cards(cards, records, seen)) == {(1, 2, "photo"), (2, 3, "url"), (3, None, "new"), (4, 3, "url"), (5, None, "new")}


def test_caches_and_snapshots(spark):
    c = "url string, v int, seen date"
    old = rows(spark, c, {"url": "a", "v": 1, "seen": D(1)}, {"url": "b", "v": 2, "seen": D(20)}, {"url": "c", "v": 3})
    assert as_set(H.upsert(old, rows(spark, c, {"url": "a", "v": 9, "seen": D(25)}), "url").select("url", "v")) == {("a", 9), ("b", 2), ("c", 3)}
    assert as_set(H.touch(old, old.filter("url = 'a'"), "url", F.lit(D(30))).select("url", "seen")) == {("a", D(30)), ("b", D(20)), ("c", None)}
    assert as_set(H.expire(old, F.lit(D(30)), 21).select("url")) == {("b",)}
    s = "k int, t string, n int"
    assert as_set(H.merge_snapshot(rows(spark, s, {"k": 1, "t": "old", "n": 5}), rows(spark, s, {"k": 1, "t": "", "n": 0}, {"k": 2, "t": "x"}), "k", ["t", "n"])) == {(1, "old", 0), (2, "x", None)}
    arr = spark.range(1).select(H.ordered_union(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), F.lit(4)), 3)).first()[0]
    assert arr == [1, 2, 3]


def test_stale_and_gone(spark):
    seen = rows(spark, OBSERVATION, {"record_id": 1, "obs_seq": 1, "date": D(1), "url": "a"}, {"record_id": 2, "obs_seq": 1, "date": D(2), "url": "b"}, {"record_id": 3, "obs_seq": 1, "date": D(14), "url": "c"})
    active = spark.createDataFrame([("b",)], "url string")
    assert as_set(H.stale_records(seen, active, F.lit(D(15))).select("record_id")) == {(1,)}
    page = "status int, redirected boolean, final_url string, body string"
    df = rows(spark, page, {"status": 404}, {"status": 200, "redirected": True, "final_url": "https://x/oferty/", "body": ""}, {"status": 500}, {}, {"status": 200, "redirected": False, "body": "Oferta archiwalna"}, {"status": 200, "redirected": False, "body": "taras"})
    got = [r[0] for r in df.select(H.gone(F.col("status"), F.col("redirected"), F.col("final_url"), F.col("body"), "(?i)archiwaln", "/oferty/?$")).collect()]
    assert got == [True, True, None, None, True, False]


def test_trails_carry_prices_over_chunks(spark):
    # Enough sightings for several chunks of one record, with unknown prices in between.
    import random

    rng = random.Random(6)
    log = [(1, i, dt.date(2020, 1, 1) + dt.timedelta(i // 3), rng.choice([None, 1, 2]), rng.choice("ab"), "s", rng.choice([None, None, "archived"])) for i in range(2600)]
    df = spark.createDataFrame(log, OBSERVATION)
    want, last = [], "none"
    for _, i, _, p, *_ in log:
        if p != last:
            want.append(i)
        last = p
    assert sorted(r["obs_seq"] for r in H.price_trail(df).collect()) == want
    changes, known = [], {}
    for _, i, _, p, u, _, status in log:
        if status != "archived" and p is not None:
            if known.get(u, p) != p:
                changes.append((i, known[u]))
            known[u] = p
    assert sorted((r["obs_seq"], r["before"]) for r in H.url_price_changes(df).collect()) == changes
    capped = sorted((r["n"], r["date"]) for r in H.timelines(H.timeline_events(df)).collect())
    assert len(capped) == 24 and [n for n, _ in capped[:2]] == [1, 2] and capped == sorted(capped, key=lambda x: x[1])


def test_archive_cards(spark):
    schema = "record_id bigint, type string, area double, title string, image string, locality string, district string, rooms int, url string, source string, price bigint, first_seen date, last_seen date, delisted date, development boolean, photo_urls array<string>"
    day = dt.date(2024, 5, 1)
    records = rows(spark, schema, {"record_id": 1, "delisted": day, "price": 7, "photo_urls": [str(k) for k in range(12)]}, {"record_id": 2, "delisted": day, "url": "own", "source": "o", "price": 8, "development": False}, {"record_id": 3, "delisted": None}, {"record_id": 4, "delisted": day, "development": True})
    log = rows(spark, OBSERVATION, {"record_id": 1, "obs_seq": 1, "date": day, "price": 0, "url": "u", "source": "s"}, {"record_id": 2, "obs_seq": 1, "date": day, "price": 5, "url": "v", "source": "t"})
    sales = rows(spark, "record_id bigint, sale_seq bigint, date date, price bigint, kind string", {"record_id": 2, "sale_seq": 1, "date": day, "price": 4, "kind": "sold"}, {"record_id": 2, "sale_seq": 2, "date": day, "price": 3, "kind": "past"})
    got = {r["record_id"]: r for r in H.archive(records, log, sales).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["price"], got[1]["url"], got[1]["source"], got[1]["sold"], len(got[1]["photo_urls"])) == (7, "u", "s", None, 8)
    assert (got[2]["price"], got[2]["url"], got[2]["source"], got[2]["sold"]["price"]) == (5, "own", "o", 4)
    assert [e["kind"] for e in got[2]["timeline"]] == ["sale_past", "listed", "delisted", "sale"] or sorted(e["kind"] for e in got[2]["timeline"]) == ["delisted", "listed", "sale", "sale_past"]
    assert H.archive(records, log).count() == 2
