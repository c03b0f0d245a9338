"""Queries of clustering, records, histories, deeds and sources that call the engine's operators whole, each with SQL written from their rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.functions import addresses as A
from plotwright.functions import photos
from plotwright.operators import clusters as C
from plotwright.operators import deeds as D
from plotwright.operators import history as H
from plotwright.operators import state as S
from plotwright.operators import views as V
from plotwright.plans import standins as Q
from plotwright.session import table
from plotwright.sources import portals as P
from plotwright.sources import tables as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a function as a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


# Deduplication

_DIST = " + ".join(f"bit_count(xor(x.h[{i}], y.h[{i}]))::INT" for i in range(1, 5))
_SAME = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in ("type", "k_area", "k_rooms", "k_alone"))
_SPARK_TEXT = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT || '.0' ELSE {0}::VARCHAR END"
DEDUPE = f"""WITH RECURSIVE l AS (SELECT *, lower(trim(locality)) AS town, coalesce(len(phashes), 0) > 0 AS hashed, {Q.DEV_SQL} AS dev FROM listing),
    up AS (SELECT seq, type, town, price, unnest(phashes) AS h FROM l WHERE hashed AND NOT dev AND town <> '' AND coalesce(price, 0) <> 0),
    ue AS (SELECT DISTINCT x.seq AS a, y.seq AS b FROM up x JOIN up y ON x.type IS NOT DISTINCT FROM y.type AND x.town = y.town AND x.price = y.price AND x.seq <> y.seq WHERE {_DIST} <= 40),
    ur AS (SELECT a AS v, a AS u FROM ue UNION SELECT ur.v, ue.b FROM ur JOIN ue ON ur.u = ue.a), uc AS (SELECT v, min(u) AS comp FROM ur GROUP BY v),
    ub AS (SELECT comp, first(area ORDER BY {Q.OFFER_ORDER}) AS b_area, first(rooms ORDER BY {Q.OFFER_ORDER}) AS b_rooms, count(DISTINCT round_even(area * 100, 0)) > 1 AS differ FROM l JOIN uc ON seq = v GROUP BY comp),
    n AS (SELECT l.* REPLACE (CASE WHEN differ THEN b_area ELSE area END AS area, CASE WHEN differ AND type = 'flat' THEN b_rooms ELSE rooms END AS rooms) FROM l LEFT JOIN uc ON seq = v LEFT JOIN ub USING (comp)),
    k AS (SELECT *, CAST(round_even(area * 100, 0) AS BIGINT) AS k_area, CASE WHEN type = 'house' THEN NULL ELSE rooms END AS k_rooms, CASE WHEN area IS NULL THEN seq END AS k_alone FROM n),
    b AS (SELECT *, bool_or(hashed) OVER (PARTITION BY type, k_area, k_rooms, k_alone) AS any_hash, concat_ws('/', coalesce(type, '-'), coalesce(k_area::VARCHAR, '-'), coalesce(k_rooms::VARCHAR, '-'), coalesce(k_alone::VARCHAR, '-')) AS blk FROM k),
    ph AS (SELECT seq, type, k_area, k_rooms, k_alone, unnest(phashes) AS h FROM b WHERE any_hash),
    pe AS (SELECT DISTINCT x.seq AS a, y.seq AS b FROM ph x JOIN ph y ON {_SAME} AND x.seq <> y.seq WHERE {_DIST} <= 40),
    pr AS (SELECT a AS v, a AS u FROM pe UNION SELECT pr.v, pe.b FROM pr JOIN pe ON pr.u = pe.a), pc AS (SELECT v, min(u) AS comp FROM pr GROUP BY v),
    s AS (SELECT blk, p, row_number() OVER (PARTITION BY blk ORDER BY p) AS i FROM (SELECT DISTINCT blk, price::DOUBLE AS p FROM b WHERE NOT any_hash AND price IS NOT NULL)),
    r AS (SELECT blk, p, i, p AS start, 0 AS part FROM s WHERE i = 1 UNION ALL SELECT s.blk, s.p, s.i, CASE WHEN s.p > r.start * 1.15::DOUBLE THEN s.p ELSE r.start END, CASE WHEN s.p > r.start * 1.15::DOUBLE THEN r.part + 1 ELSE r.part END FROM r JOIN s ON s.blk = r.blk AND s.i = r.i + 1),
    based AS (SELECT b.*, 'p' || coalesce(comp, seq) AS grp, NULL::INT AS part FROM b LEFT JOIN pc ON seq = v WHERE any_hash UNION ALL SELECT b.*, 'b' || b.blk AS grp, coalesce(r.part, 0) AS part FROM b LEFT JOIN r ON r.blk = b.blk AND r.p = price::DOUBLE WHERE NOT any_hash),
    fl AS (SELECT grp, bool_or(d) OR max(n) >= 3 AS developer FROM (SELECT grp, source, count(DISTINCT coalesce(source_id, '<none>')) AS n, bool_or(dev) AS d FROM based GROUP BY grp, source) GROUP BY grp),
    c AS (SELECT based.*, developer, CASE WHEN developer THEN grp || '@' || coalesce(price::VARCHAR, '-') WHEN part IS NULL THEN grp ELSE grp || '#' || part END AS cluster FROM based JOIN fl USING (grp)),
    src AS (SELECT cluster, string_agg(source, ',' ORDER BY {Q.RANK_SQL}, source) AS sources FROM (SELECT DISTINCT cluster, source FROM c) GROUP BY cluster)
    SELECT cluster, min(seq) AS seq, {', '.join(f"first({x} ORDER BY {Q.OFFER_ORDER}) FILTER (WHERE {x} IS NOT NULL AND {x}::VARCHAR <> '') AS {x}" for x in ('type', 'area', 'rooms', 'street'))}, min(price) AS price, max(price) AS price_max, any_value(sources) AS sources,
      count(DISTINCT coalesce(url, '')) AS n_offers, bool_or(developer) AS development FROM c JOIN src USING (cluster) GROUP BY cluster"""


@query(DEDUPE)
def q_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Listings to property cards, the whole way: sizes unified, photo and price clusters, developments cut by price, cards built."""
    cards = C.dedupe(table(spark, d, "listing"))
    return cards.select("cluster", "seq", "type", "area", "rooms", "street", "price", "price_max", F.array_join("sources", ",").alias("sources"), F.size("offers").cast("bigint").alias("n_offers"), "development")


_PLACE = "type || '|' || CAST(round_even(area, 0) AS BIGINT) || '|' || rooms"


@query(f"""WITH c AS (SELECT *, {_PLACE} AS cluster FROM listing WHERE area IS NOT NULL AND rooms IS NOT NULL AND type IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY cluster, coalesce(url, '') ORDER BY {Q.OFFER_ORDER}) AS k FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY price IS NULL, price, {Q.OFFER_ORDER}) AS place FROM o WHERE k = 1)
    SELECT cluster, place::BIGINT AS place, source, url, price, created, is_private, agency, place = 1 AND price IS NOT NULL AS cheapest FROM p""")
def q_card_offers(spark: SparkSession, d: str) -> DataFrame:
    """The offers of cards in their order, one per address, with the cheapest marked."""
    rows = table(spark, d, "listing").filter("area is not null and rooms is not null and type is not null").withColumns({"cluster": F.concat_ws("|", "type", F.bround("area").cast("bigint"), "rooms"), "developer": F.lit(False)})
    offers = C.build_cards(rows).select("cluster", "cheapest", F.posexplode("offers").alias("at", "o"))
    return offers.select("cluster", (F.col("at") + 1).cast("bigint").alias("place"), "o.source", "o.url", "o.price", "o.created", "o.is_private", "o.agency", ((F.col("at") == 0) & F.col("cheapest").isNotNull()).alias("cheapest"))


@query(f"""WITH c AS (SELECT seq, url, source, price, type, CAST(round_even(area * 100, 0) AS BIGINT) AS a, rooms, lower(trim(coalesce(nullif(street, ''), locality))) AS place FROM listing WHERE NOT {Q.DEV_SQL} AND area IS NOT NULL),
    g AS (SELECT type, a, rooms, place FROM c WHERE place <> '' GROUP BY ALL HAVING count(DISTINCT coalesce(url, '')) BETWEEN 2 AND 3)
    SELECT c.seq, (SELECT min(o.price) FROM c o WHERE o.type IS NOT DISTINCT FROM c.type AND o.a = c.a AND o.rooms IS NOT DISTINCT FROM c.rooms AND o.place = c.place AND o.url IS DISTINCT FROM c.url) AS prev_price, true AS relisted
    FROM c JOIN g ON g.type IS NOT DISTINCT FROM c.type AND g.a = c.a AND g.rooms IS NOT DISTINCT FROM c.rooms AND g.place = c.place""")
def q_link_same_size(spark: SparkSession, d: str) -> DataFrame:
    """Advertisements of one size and street that two or three addresses share."""
    cards = table(spark, d, "listing").withColumn("development", C.is_developer(F.col("market"), F.col("title")))
    return C.link_same_size(cards).select("seq", "prev_price", "relisted")


# Records


def _one_per_ad(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each advertisement as a card without pictures."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    rows = table(spark, d, "listing").filter("source is not null and source_id is not null")
    first = rows.groupBy("source", "source_id").agg(F.min("seq").alias("seq")).select("seq")
    return rows.join(first, "seq", "left_semi").select("seq", "type", "area", "url", "price", "source", "title", "image", "locality", "district", "street", "rooms", "floor", "plot_area", none("phashes", "array<array<bigint>>"), none("photo_urls", "array<string>"), F.lit(False).alias("development"))


_ADS = "ads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY seq) AS k FROM listing WHERE source IS NOT NULL AND source_id IS NOT NULL) WHERE k = 1)"


@query(f"""WITH {_ADS}, h AS (SELECT *, CASE WHEN url IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY url) END + 1 AS rid FROM ads), m AS (SELECT max(rid) AS m FROM h),
    again AS (SELECT h.*, CASE WHEN url IS NULL THEN m.m + seq + 1 ELSE rid END AS rid2 FROM h, m WHERE type = 'flat'),
    seen AS (SELECT rid AS record_id, DATE '2024-01-01' AS day, url, seq, price, 1 AS run FROM h UNION ALL SELECT rid2, DATE '2024-01-02', url, seq, price, 2 FROM again)
    SELECT record_id, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT day || coalesce(url, '')) AS sightings, first(price ORDER BY run DESC, seq DESC) FILTER (WHERE price IS NOT NULL) AS price FROM seen GROUP BY 1""")
def q_update(spark: SparkSession, d: str) -> DataFrame:
    """Two days of cards taken into an empty state: all advertisements, then the flats again."""
    cards = _one_per_ad(spark, d)
    log = spark.createDataFrame([], "record_id bigint, obs_seq bigint, date date, price bigint, url string, source string, status string")
    records = Q._records(log).limit(0)
    for day, batch in (("2024-01-01", cards), ("2024-01-02", cards.filter("type = 'flat'"))):
        records, log, _ = S.update(records, log, batch, F.lit(day).cast("date"))
    return records.select("record_id", "first_seen", "last_seen", "price").join(log.groupBy("record_id").agg(F.count(F.lit(1)).alias("sightings")), "record_id")


_LIVE = "coalesce(status, '') <> 'archived'"


@query("""WITH t AS (SELECT max(date) - 300 AS cut, max(date) + 1 AS today FROM observation), live AS (SELECT o.* FROM observation o, t WHERE date < cut OR date IS NULL), ui AS (SELECT url, max(record_id) AS rid FROM live WHERE url IS NOT NULL GROUP BY 1)
    SELECT rid AS record_id, today AS delisted, count(DISTINCT o.url) AS closed FROM observation o JOIN ui USING (url), t WHERE o.date >= cut GROUP BY 1, 2""")
def q_observe_archived(spark: SparkSession, d: str) -> DataFrame:
    """The sightings of the last 300 days told as closed advertisements to the records of the days before: those that know the address are delisted."""
    log = table(spark, d, "observation").withColumn("status", F.lit(None).cast("string"))
    last = log.agg(F.max("date")).first()[0]
    today, old = F.date_add(F.lit(last), 1), F.coalesce(F.col("date") < F.date_sub(F.lit(last), 300), F.lit(True))
    closed = log.filter(~old).select((F.col("record_id") * 1000 + F.col("obs_seq")).alias("seq"), "url", "price", "source", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("area"), F.lit(None).cast("array<array<bigint>>").alias("phashes")).dropDuplicates(["seq"])
    live = log.filter(old)
    records, after = S.observe_archived(Q._records(live), live, closed, today)
    news = after.filter("status = 'archived'").groupBy("record_id").agg(F.count(F.lit(1)).alias("closed"))
    return records.filter("delisted is not null").select("record_id", "delisted").join(news, "record_id")


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY date DESC NULLS LAST, obs_seq, url NULLS FIRST, source NULLS FIRST, price NULLS FIRST) AS k FROM one) WHERE k = 1"


@query(f"""WITH one AS (SELECT * FROM observation), last AS ({_LAST}), span AS (SELECT record_id, max(date) + 1 AS delisted FROM observation GROUP BY 1),
    ev AS (SELECT record_id, count(*) AS n FROM (SELECT DISTINCT record_id, url FROM observation WHERE {_LIVE}) GROUP BY 1 UNION ALL SELECT record_id, count(*) FROM observation WHERE status = 'archived' GROUP BY 1
      UNION ALL SELECT record_id, count(*) FROM (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY record_id, url ORDER BY date NULLS FIRST, obs_seq NULLS FIRST, price NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM observation WHERE {_LIVE}) WHERE price <> before GROUP BY 1),
    total AS (SELECT record_id, sum(n) AS n FROM ev GROUP BY 1), known AS (SELECT record_id, max(price) AS top FROM observation GROUP BY 1)
    SELECT record_id, url, source, nullif(price, 0) AS price, delisted, CASE WHEN top > 0 THEN top END AS sold_price, least(24, coalesce(n, 0) + 1 + CASE WHEN top > 0 THEN 1 ELSE 0 END)::BIGINT AS n_events
    FROM last JOIN span USING (record_id) LEFT JOIN total USING (record_id) JOIN known USING (record_id) WHERE delisted IS NOT NULL""")
def q_archive_cards(spark: SparkSession, d: str) -> DataFrame:
    """All records taken as delisted the day after they were last seen, as cards of the archive, with a sale at their highest price."""
    log = table(spark, d, "observation")
    ranked = log.withColumn("r", F.struct("url", "source", "price", "status"))
    one = H.first_sightings(ranked, ["record_id", "date", "obs_seq"], ["r"]).drop("r").unionByName(log.limit(0))
    records = Q._records(log).withColumn("delisted", F.date_add("last_seen", 1))
    sales = log.groupBy("record_id").agg(F.max("price").alias("price"), F.date_add(F.max("date"), 30).alias("date")).filter("price > 0").select("record_id", F.lit(1).cast("bigint").alias("sale_seq"), "date", "price", F.lit("sold").alias("kind"))
    events = H.archive(records, log, sales)
    last = H.last_sighting(one).select("record_id", "url", "source", F.nullif("price", F.lit(0)).alias("price"))
    return events.select("record_id", "delisted", F.col("sold.price").alias("sold_price"), F.size("timeline").cast("bigint").alias("n_events")).join(last, "record_id")


@query("""WITH ui AS (SELECT url, max(record_id) AS rid FROM observation WHERE url IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT record_id * 1000 + obs_seq AS pin, url, CASE WHEN obs_seq % 2 = 0 THEN 'S' || obs_seq END AS street, (obs_seq % 5)::INT AS rooms FROM observation WHERE url IS NOT NULL)
    SELECT rid AS record_id, first(street ORDER BY pin DESC, url DESC) FILTER (WHERE street IS NOT NULL) AS street, first(rooms ORDER BY pin DESC, url DESC) AS rooms FROM p JOIN ui USING (url) GROUP BY 1""")
def q_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Pins by address put on records, field by field the last one."""
    log = table(spark, d, "observation")
    pins = log.filter("url is not null").select((F.col("record_id") * 1000 + F.col("obs_seq")).alias("pin_seq"), "url", F.when(F.col("obs_seq") % 2 == 0, F.concat(F.lit("S"), "obs_seq")).alias("street"), (F.col("obs_seq") % 5).cast("int").alias("rooms")).distinct()
    return S.apply_overrides(Q._records(log), log, pins).filter("manual").select("record_id", "street", "rooms")


_NEAR = f"x.type = y.type AND abs(CAST(round_even(x.area, 0) AS BIGINT) - CAST(round_even(y.area, 0) AS BIGINT)) <= 1 AND {_DIST} <= 40"


@query(f"""WITH f AS (SELECT *, CAST(round_even(area, 0) AS BIGINT) AS bucket FROM listing), rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY seq) AS k FROM f WHERE source_id IS NOT NULL) WHERE k = 1),
    c AS (SELECT seq, type, area, unnest(phashes) AS h FROM f), r AS (SELECT seq, type, area, bucket, unnest(phashes) AS h FROM rec)
    SELECT x.seq, first(y.seq ORDER BY y.bucket, y.seq) AS record_id FROM c x JOIN r y ON x.type = y.type AND y.bucket BETWEEN CAST(round_even(x.area, 0) AS BIGINT) - 1 AND CAST(round_even(x.area, 0) AS BIGINT) + 1 WHERE {_DIST} <= 40 GROUP BY 1""")
def q_match_by_photo(spark: SparkSession, d: str) -> DataFrame:
    """The record of each advertisement by its pictures, among records made of the first rows of the advertisements."""
    rows = table(spark, d, "listing").select("seq", "source", "source_id", "type", "area", "phashes")
    known = rows.filter("source_id is not null")
    first = known.groupBy("source", "source_id").agg(F.min("seq").alias("seq")).select("seq")
    records = known.join(first, "seq", "left_semi").select(F.col("seq").alias("record_id"), F.col("seq").alias("record_ord"), "type", "area", F.col("phashes").alias("hashes"))
    return H.match_by_photo(rows, records)


@query(f"""WITH RECURSIVE c AS (SELECT seq, type, area, url, unnest(phashes) AS h FROM listing), e AS (SELECT DISTINCT x.seq AS a, y.seq AS b FROM c x JOIN c y ON {_NEAR} AND x.seq < y.seq UNION SELECT min(seq) OVER (PARTITION BY url), seq FROM listing WHERE url IS NOT NULL),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT seq AS v, seq AS u FROM listing UNION SELECT r.v, s.b FROM r JOIN s ON r.u = s.a) SELECT v AS seq, min(u) AS head FROM r GROUP BY v""")
def q_group_new_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards without a record that belong to one new record, by address or pictures."""
    return S.group_new_cards(table(spark, d, "listing").select("seq", "type", "area", "url", "phashes", F.lit(False).alias("development")))


# Deeds


def _deed_records(spark: SparkSession, d: str) -> DataFrame:
    """A property for each deed, with one or the other detail missing, so that every rule of the score decides somewhere."""
    on = lambda k, c: F.when(F.col("deed_id") % k != 0, F.col(c))
    return table(spark, d, "deed").select(
        F.col("deed_id").alias("record_id"), F.col("kind").alias("type"), F.coalesce("a", F.lit(50.5)).alias("area"), on(11, "msc").alias("locality"), F.lit(None).cast("string").alias("district"), on(3, "ul").alias("street"), on(4, "nr").alias("nr"),
        F.when(F.col("deed_id") % 5 == 0, F.col("dz")).alias("dzialka_id"), F.col("izb").alias("rooms"), (F.col("kond") - 1).alias("floor_no"), on(7, "grunt").alias("plot_area"), F.date_sub("d", 40).alias("first_seen"), F.when(F.col("deed_id") % 2 == 0, F.date_sub("d", 10)).alias("delisted"), (F.col("deed_id") % 17 == 0).alias("development"),
    )


_F = lambda c: Q._TOWN.format(c)
_KNOWN = lambda c: f"coalesce({c}::VARCHAR, '') <> ''"
_SCORED = f"""rec AS (SELECT * FROM (SELECT deed_id AS record_id, kind AS type, coalesce(a, 50.5) AS area, CASE WHEN deed_id % 11 <> 0 THEN msc END AS locality, CASE WHEN deed_id % 3 <> 0 THEN ul END AS street, CASE WHEN deed_id % 4 <> 0 THEN nr END AS nr, CASE WHEN deed_id % 5 = 0 THEN dz END AS dzialka_id,
      izb AS rooms, kond - 1 AS floor_no, CASE WHEN deed_id % 7 <> 0 THEN grunt END AS plot_area, d - 40 AS first_seen, CASE WHEN deed_id % 2 = 0 THEN d - 10 END AS delisted FROM deed) WHERE record_id % 17 <> 0),
    dd AS (SELECT *, {_F('msc')} AS town FROM deed), t AS (SELECT DISTINCT kind, town FROM dd WHERE town <> ''), r AS (SELECT rec.*, t.town FROM rec LEFT JOIN t ON t.kind = rec.type AND t.town = {_F('rec.locality')}),
    c0 AS (SELECT record_id, type, area, street, r.nr AS r_nr, dzialka_id, rooms, floor_no, plot_area, first_seen, delisted, dd.deed_id, dd.d, dd.c, dd.a, dd.izb, dd.kond, dd.grunt, dd.rynek, dd.ul, dd.nr, dd.dz FROM r JOIN dd ON dd.town = r.town AND dd.kind = r.type
      WHERE abs(r.area - dd.a) <= 0.6::DOUBLE OR (dd.a IS NULL AND coalesce(dd.ul, '') <> '' AND ({_KNOWN('r.nr')} OR {_KNOWN('dzialka_id')}))),
    c1 AS (SELECT *, count(*) OVER (PARTITION BY record_id) = 1 AND abs(area - round_even(area, 0)) > 0.01 AS alone, {_KNOWN('street')} AND {_KNOWN('ul')} AS streets, {_KNOWN('r_nr')} AND {_KNOWN('nr')} AS numbers, {_KNOWN('dzialka_id')} AND {_KNOWN('dz')} AS parcels,
      {Q._WORDS.format("coalesce(street, '')")} AS wa, {Q._WORDS.format("coalesce(ul, '')")} AS wb FROM c0),
    f AS (SELECT *, CASE WHEN len(wa) <= len(wb) THEN wa ELSE wb END AS few, CASE WHEN len(wa) <= len(wb) THEN wb ELSE wa END AS many FROM c1),
    g AS (SELECT *, coalesce({Q._AGREE}, false) AS agree FROM f),
    s AS (SELECT *, CASE WHEN parcels AND {_F('dzialka_id')} = {_F('dz')} THEN 2 WHEN streets AND agree AND numbers THEN CASE WHEN {_F('r_nr')} = {_F('nr')} THEN 2 ELSE 0 END WHEN streets AND agree THEN CASE WHEN a IS NULL THEN 0 ELSE 2 END WHEN streets OR parcels OR a IS NULL THEN 0
      WHEN type = 'flat' THEN CASE WHEN rooms <> izb OR (kond <> floor_no AND kond <> floor_no + 1) THEN 0 WHEN rooms IS NOT NULL AND izb IS NOT NULL AND kond IS NOT NULL AND floor_no IS NOT NULL THEN 1 WHEN alone THEN 1 ELSE 0 END
      WHEN plot_area <> 0 AND grunt <> 0 AND abs(plot_area - grunt) <= 0.1::DOUBLE * greatest(plot_area, grunt) THEN 1 WHEN alone AND (coalesce(plot_area, 0) = 0 OR coalesce(grunt, 0) = 0) THEN 1 ELSE 0 END AS score FROM g),
    w AS (SELECT *, 'past' AS sale FROM s WHERE score > 0 AND (first_seen IS NULL OR d <= first_seen - 1) UNION ALL SELECT *, 'sold' FROM s WHERE score > 0 AND d BETWEEN delisted - 60 AND delisted + 400),
    b AS (SELECT *, count(*) OVER (PARTITION BY record_id, sale) AS n FROM (SELECT *, max(score) OVER (PARTITION BY record_id, sale) AS top FROM w) WHERE score = top),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, d, c ORDER BY sale, dz NULLS FIRST, ul NULLS FIRST, nr NULLS FIRST) AS k FROM b WHERE (sale = 'sold' AND n = 1) OR (sale = 'past' AND n <= 3)) WHERE k = 1)"""


@query(f"""WITH {_SCORED} SELECT record_id, sale AS kind, d, c AS price, CASE WHEN a > 0 THEN CAST(round_even(c / a, 0) AS BIGINT) END AS price_m2, score, CASE score WHEN 2 THEN 'high' ELSE 'medium' END AS confidence, CASE rynek WHEN 'p' THEN 'primary' WHEN 'w' THEN 'secondary' END AS market,
    nullif(concat_ws(' ', nullif(ul, ''), nullif(nr, '')), '') AS addr, dz FROM kept""")
def q_deed_sales(spark: SparkSession, d: str) -> DataFrame:
    """Deeds attached to properties by street, number, parcel, rooms, storey, plot and uniqueness, with what is known of them."""
    return D.match_deeds(_deed_records(spark, d), table(spark, d, "deed").drop("deed_id"))


@query(f"""WITH {_SCORED} SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM c0 WHERE c0.record_id = rec.record_id) THEN CASE WHEN coalesce({_F('locality')}, '') = '' THEN 'no_location' ELSE 'no_candidates' END WHEN EXISTS (SELECT 1 FROM kept WHERE kept.record_id = rec.record_id) THEN 'matched' ELSE 'rejected' END AS stage, count(*) AS n FROM rec GROUP BY 1""")
def q_deed_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How far each property came: no location, no candidates, rejected, matched."""
    return D.match_funnel(_deed_records(spark, d), table(spark, d, "deed").drop("deed_id"))


@query(f"""SELECT d, c, a, ul, nr, dz FROM deed WHERE {_F('msc')} = 'tlunybrowa' AND kind = 'flat' AND abs(a - 50) <= 2""")
def q_deed_report(spark: SparkSession, d: str) -> DataFrame:
    """The lookup report for a flat of about 50 square metres in one town."""
    return D.report(table(spark, d, "deed"), "Tłunybrowa", "flat", 50.0, rooms=2, tolerance=2.0).select("d", "c", "a", "ul", "nr", "dz")


# Sources and outputs


@query("SELECT kind, d, c, a, nullif(left(rynek, 1), '') AS rynek, nullif(trim(msc), '') AS msc, nullif(trim(ul), '') AS ul, nullif(trim(nr), '') AS nr, grunt, nullif(trim(dz), '') AS dz FROM (SELECT DISTINCT kind, d, c, a, rynek, msc, ul, nr, grunt, dz FROM deed WHERE kind = 'house' AND c <> 0 AND d IS NOT NULL)")
def q_read_register_houses(spark: SparkSession, d: str) -> DataFrame:
    """Deeds of houses written as register pages and read back as typed deeds."""
    rows = table(spark, d, "deed").filter("kind = 'house'")
    tag = lambda n, c: F.coalesce(F.concat(F.lit(f"<ms:{n}>"), F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</ms:{n}>")), F.lit(f"<ms:{n}/>"))
    address = F.concat(F.lit("MSC:"), F.coalesce("msc", F.lit("")), F.lit(";UL:"), F.coalesce("ul", F.lit("")), F.lit(";NR_PORZ:"), F.coalesce("nr", F.lit("")))
    xml = F.concat(
        F.lit('<c><m><ms:budynki gml:id="1"><ms:msGeometry><gml:pos>1 2</gml:pos></ms:msGeometry>'), tag("dok_data", F.concat(F.col("d").cast("string"), F.lit("T00:00:00+01:00"))), tag("tran_rodzaj_trans", F.lit("wolnyRynek")), tag("tran_rodzaj_rynku", F.col("rynek")),
        tag("bud_cena_brutto", F.col("c")), tag("bud_pow_uzyt", F.col("a")), tag("bud_adres", address), tag("nier_pow_gruntu", F.col("grunt")), tag("bud_id_budynku", F.concat("dz", F.lit("_BUD.1"))), F.lit("</ms:budynki></m></c>"),
    )
    return D.clean_deeds(T.register_features(rows.select(xml.alias("xml")), "house"), "house").select("kind", "d", "c", "a", "rynek", "msc", "ul", "nr", "grunt", "dz").distinct()


def _card_pages(rows: DataFrame, path: str) -> DataFrame:
    mark = lambda m, c: F.concat(F.lit(f'<p data-cy="{m}">'), F.coalesce(c, F.lit("")), F.lit("</p>"))
    html = F.concat(F.lit(f'<html><div data-cy="card"><a data-cy="propertyUrl" href="{path}'), F.col("seq"), F.lit('">x</a>'), mark("propertyCardPrice", F.concat(F.col("price"), F.lit(" zł"))), mark("cardPropertyInfoRooms", F.col("rooms").cast("string")), F.lit("</div></html>"))
    return rows.select(html.alias("html"), "type", F.lit(None).cast("string").alias("town"))


@query("SELECT source, type, url, n, rooms, failed FROM (SELECT 'gratka' AS source, type, 'https://gratka.pl/ob/' || seq AS url, 1 AS n, rooms, 'broken' AS failed FROM listing UNION ALL SELECT 'morizon', type, 'https://www.morizon.pl/oferta/mzn' || seq, 1, rooms, 'broken' FROM listing)")
def q_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two portals, each page twice, and of one whose pages cannot be read: each advertisement once, the third reported."""
    rows = table(spark, d, "listing").select("seq", "type", "price", "rooms")

    def broken(pages: DataFrame) -> DataFrame:
        return P.gratka(pages).withColumn("price", F.raise_error(F.lit("the layout changed")).cast("bigint"))

    one, two = _card_pages(rows, "/ob/"), _card_pages(rows, "/oferta/mzn")
    found, failed = P.scan({"gratka": one.unionByName(one), "morizon": two.unionByName(two), "broken": one.limit(1)}, P.SOURCES | {"broken": broken})
    return found.groupBy("source", "type", "url", "rooms").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("failed", F.lit(",".join(sorted(failed))))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, type, url ORDER BY seq) AS k FROM (SELECT source, type, url, seq FROM listing)) WHERE k = 1 OR url IS NULL OR source NOT IN ('gratka', 'morizon', 'nieruchomosci-online')".replace("SELECT * FROM (SELECT *, row", "SELECT source, type, url, seq FROM (SELECT *, row"))
def q_distinct_in_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a scan without repeated addresses of the portals that repeat them."""
    rows = table(spark, d, "listing").select("source", "type", "url", "seq", F.col("seq").alias("ordinal"))
    return P.distinct_in_scan(rows).drop("ordinal")


@query(f"""SELECT 'raw' AS what, count(*) AS n FROM listing UNION ALL SELECT 'cards', count(*) FROM listing UNION ALL SELECT 'source ' || coalesce(nullif(source, ''), 'unknown'), count(*) FROM listing GROUP BY 1 UNION ALL SELECT 'type ' || coalesce(nullif(type, ''), 'unknown'), count(*) FROM listing GROUP BY 1
    UNION ALL SELECT 'relisted', count(*) FILTER (WHERE archived) FROM listing UNION ALL SELECT 'archive', count(*) FROM archive_row UNION ALL SELECT 'sold', count(*) FILTER (WHERE price > 0 AND archive_id % 3 = 0) FROM archive_row""")
def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a published run says of itself, as rows."""
    cards = table(spark, d, "listing").withColumn("relisted", F.coalesce("archived", F.lit(False)))
    archive = table(spark, d, "archive_row").withColumn("sold", F.when((F.col("archive_id") % 3 == 0) & (F.col("price") > 0), F.col("price")))
    row = T.run_summary(cards, archive, cards)
    one = lambda name, c: F.struct(F.lit(name).alias("what"), F.col(c).alias("n"))
    named = lambda prefix, c: F.transform(F.map_entries(c), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("what"), e["value"].alias("n")))
    return row.select(F.explode(F.concat(F.array(one("raw", "raw"), one("cards", "count"), one("relisted", "relisted"), one("archive", "archive"), one("sold", "sold_confirmed")), named("source ", "by_source"), named("type ", "by_type"))).alias("r")).select("r.what", "r.n")


# Scalars and small operators, over whole tables


@query("""SELECT seq, CASE WHEN s IN (404, 410) THEN true WHEN seq % 3 = 0 AND url LIKE '%/' THEN true WHEN s <> 200 OR s IS NULL THEN NULL ELSE contains(coalesce(title, ''), 'Dom') END AS gone
    FROM (SELECT *, CASE seq % 5 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS s FROM listing)""")
def q_gone(spark: SparkSession, d: str) -> DataFrame:
    """What fetched pages say of their advertisements: gone, there, or nothing."""
    rows = table(spark, d, "listing")
    status = F.when(F.col("seq") % 5 == 0, 404).when(F.col("seq") % 5 == 2, 500).when(F.col("seq") % 5 != 3, 200)
    return rows.select("seq", H.gone(status, F.col("seq") % 3 == 0, F.col("url"), F.coalesce("title", F.lit("")), "Dom", "/$").alias("gone"))


_HOUSE = "regexp_replace(lower({}), '[^0-9a-z/]', '', 'g')"


@query(f"""SELECT deed_id, coalesce({_HOUSE.format('nr')} = {_HOUSE.format("' ' || upper(nr) || '.'")} AND {_HOUSE.format('nr')} <> '', false) AS same, coalesce({_HOUSE.format('nr')} = {_HOUSE.format("replace(nr, 'A', '')")} AND {_HOUSE.format('nr')} <> '', false) AS bare FROM deed""")
def q_numbers_agree(spark: SparkSession, d: str) -> DataFrame:
    """House numbers against themselves in other dress, and without their letter A."""
    nr = F.col("nr")
    return table(spark, d, "deed").select("deed_id", A.numbers_agree(nr, F.concat(F.lit(" "), F.upper(nr), F.lit("."))).alias("same"), A.numbers_agree(nr, F.replace(nr, F.lit("A"), F.lit(""))).alias("bare"))


@query("SELECT seq, CASE WHEN locality IN ('Tlunybrowa', 'TŁUNYBROWA') THEN 'Tłunybrowa' ELSE locality END AS town FROM listing")
def q_merged_town(spark: SparkSession, d: str) -> DataFrame:
    """Districts given as towns taken for their city."""
    return table(spark, d, "listing").select("seq", A.merged_town(F.col("locality"), ["Tlunybrowa", "TŁUNYBROWA"], "Tłunybrowa").alias("town"))


@query("""WITH p AS (SELECT vec_id, list_transform(range(0, 272), lambda i: CAST(floor((embedding[(i * 7) % 64 + 1] + 2) * 10) AS INT)) AS g FROM embeddings)
    SELECT vec_id, list_sum(list_transform(range(0, 256), lambda i: CASE WHEN g[(i // 16) * 17 + i % 16 + 1] < g[(i // 16) * 17 + i % 16 + 2] THEN 1 ELSE 0 END))::BIGINT AS ones FROM p""")
def q_difference_hash(spark: SparkSession, d: str) -> DataFrame:
    """Bits set in the difference hashes of grey pictures made of embeddings."""
    grey = F.transform(F.sequence(F.lit(0), F.lit(271)), lambda i: F.floor((F.get("embedding", (i * 7) % 64) + 2) * 10).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.get(F.transform(F.array(grey), lambda g: F.aggregate(F.transform(photos.difference_hash(g), lambda x: F.bit_count(x)), F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("bigint").alias("ones"))


@query("""SELECT archive_id, CASE WHEN len(timeline) >= 2 THEN len(timeline) ELSE 0 END::BIGINT AS lines, coalesce(CASE WHEN len(timeline) >= 2 THEN len(list_filter(timeline, lambda e: e.url = url AND hi > lo)) END, 0)::BIGINT AS best
    FROM (SELECT *, list_max(list_transform(timeline, lambda e: e.price)) AS hi, list_min(list_transform(timeline, lambda e: e.price)) AS lo FROM archive_row)""")
def q_offer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events of archived properties shown as a list of offers, the property's own address marked as the best."""
    lines = V.offer_lines(F.col("timeline"), F.col("url"))
    shown = F.coalesce(lines, F.array().cast("array<struct<source:string,price:bigint,best:boolean>>"))
    return table(spark, d, "archive_row").select("archive_id", F.size(shown).cast("bigint").alias("lines"), F.size(F.filter(shown, lambda o: o["best"])).cast("bigint").alias("best"))


@query("""SELECT archive_id, concat_ws(',', CASE WHEN rooms > 2 THEN 'relisted' END, CASE WHEN area - 50 >= 1 THEN 'discount' END, CASE WHEN len(photo_urls) > 0 THEN 'also_listed' WHEN len(timeline) > 1 THEN 'trail' WHEN price IS NOT NULL THEN 'previous' END) AS line FROM archive_row""")
def q_history_line(spark: SparkSession, d: str) -> DataFrame:
    """What cards say of their past, strongest first."""
    c = F.col
    return table(spark, d, "archive_row").select("archive_id", F.array_join(V.history_line(c("rooms") > 2, c("area") - 50, c("photo_urls"), c("timeline"), c("price")), ",").alias("line"))


@query("SELECT archive_id, list_filter(timeline, lambda e: e.kind = 'listed' AND e.price > 0)[-1].price AS price FROM archive_row")
def q_last_past_sale(spark: SparkSession, d: str) -> DataFrame:
    """The last priced listing of archived properties, taken as their last earlier sale."""
    sales = F.transform("timeline", lambda e: F.struct(F.when(e["kind"] == "listed", "past").otherwise(e["kind"]).alias("kind"), e["price"].alias("price")))
    return table(spark, d, "archive_row").select("archive_id", V.last_past_sale(sales)["price"].alias("price"))


@query("""WITH o AS (SELECT url, min(street) AS street, min(rooms) AS rooms FROM listing WHERE url IS NOT NULL GROUP BY url), n AS (SELECT url, max('N' || obs_seq) AS nr, max((obs_seq % 7)::INT) FILTER (WHERE obs_seq % 2 = 0) AS rooms FROM observation WHERE url IS NOT NULL GROUP BY url)
    SELECT url, street, nr, coalesce(n.rooms, o.rooms) AS rooms FROM o FULL JOIN n USING (url)""")
def q_pin(spark: SparkSession, d: str) -> DataFrame:
    """Details learned of addresses pinned over those known: known fields replace, unknown ones change nothing."""
    old = table(spark, d, "listing").filter("url is not null").groupBy("url").agg(F.min("street").alias("street"), F.min("rooms").alias("rooms")).withColumn("nr", F.lit(None).cast("string"))
    new = table(spark, d, "observation").select("url", F.lit(None).cast("string").alias("street"), F.concat(F.lit("N"), "obs_seq").alias("nr"), F.when(F.col("obs_seq") % 2 == 0, (F.col("obs_seq") % 7).cast("int")).alias("rooms"))
    return T.pin(old, new).select("url", "street", "nr", "rooms")


@query("""WITH c AS (SELECT url, first(phashes ORDER BY seq) AS h FROM listing WHERE url IS NOT NULL AND len(phashes) > 0 GROUP BY url)
    SELECT seq, coalesce(len(h), -1)::BIGINT AS hashes, url IS NOT NULL AND h IS NULL AS missed FROM listing LEFT JOIN c USING (url)""")
def q_attach_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes attached to advertisements from a cache of those known by address, and the addresses still to be hashed."""
    rows = table(spark, d, "listing")
    cache = rows.filter("url is not null and size(phashes) > 0").groupBy("url").agg(F.min_by("phashes", "seq").alias("hashes")).withColumn("urls", F.lit(None).cast("array<string>"))
    found, missed = S.attach_hashes(rows, cache)
    missed = missed.select("url", F.lit(True).alias("missed")).distinct()
    return found.join(missed, "url", "left").select("seq", F.coalesce(F.size("phashes"), F.lit(-1)).cast("bigint").alias("hashes"), F.coalesce("missed", F.lit(False)).alias("missed"))


@query("""SELECT record_id, count(*) AS n FROM (SELECT record_id, url, min(obs_seq) AS first_seq, row_number() OVER (PARTITION BY record_id ORDER BY min(obs_seq), url NULLS FIRST) AS k FROM observation GROUP BY record_id, url) WHERE k <= 2 GROUP BY 1""")
def q_ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """The first two addresses a record was seen under: a capped union, old ones first."""
    log = table(spark, d, "observation")
    first = log.groupBy("record_id", "url").agg(F.min("obs_seq").alias("o")).groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "url"))), lambda s: F.coalesce(s["url"], F.lit(""))).alias("urls"))
    return first.select("record_id", F.size(H.ordered_union(F.slice("urls", 1, 1), F.col("urls"), 2)).cast("bigint").alias("n"))


@query("SELECT seq, source, n FROM (SELECT seq, 'gratka' AS source, least(5, coalesce(len(photo_urls), 0))::BIGINT AS n FROM listing UNION ALL SELECT seq, 'otodom', least(5, len(list_distinct(photo_urls)))::BIGINT FROM listing WHERE photo_urls IS NOT NULL)")
def q_gallery(spark: SparkSession, d: str) -> DataFrame:
    """Picture addresses read back out of advertisement pages of two portals."""
    rows = table(spark, d, "listing").select("seq", "photo_urls")
    numbered = F.transform(F.coalesce("photo_urls", F.array().cast("array<string>")), lambda u, i: F.concat(F.lit('<img src="https://thumbs.cdngr.pl/thumb/'), i, F.lit('.jpg">')))
    one = rows.select("seq", F.lit("gratka").alias("source"), F.array_join(numbered, "").alias("html"))
    images = F.to_json(F.struct(F.struct(F.struct(F.struct(F.transform("photo_urls", lambda u: F.struct(u.alias("large"))).alias("images")).alias("ad")).alias("pageProps")).alias("props")))
    two = rows.filter("photo_urls is not null").select("seq", F.lit("otodom").alias("source"), F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), images, F.lit("</script>")).alias("html"))
    return one.unionByName(two).select("seq", "source", F.size(P.gallery(F.col("source"), F.col("html"))).cast("bigint").alias("n"))


@query("SELECT deed_id, d, a FROM deed WHERE kind = 'flat' AND msc = 'Tłunybrowa' AND d >= DATE '2024-01-01' AND a BETWEEN 40 AND 70")
def q_register_table(spark: SparkSession, d: str) -> DataFrame:
    """Deeds of one kind, town, time and size, read with conditions and columns in the scan."""
    return T.register_table(spark, f"{d}/deed.parquet", "flat", "Tłunybrowa", dt.date(2024, 1, 1), (40, 70), columns=("deed_id", "d", "a"))


@query("""SELECT c_custkey, (SELECT min(s_suppkey) FROM supplier WHERE c_acctbal BETWEEN s_acctbal AND s_acctbal + 300 AND c_custkey % 1000 BETWEEN s_suppkey * 7 % 1000 AND s_suppkey * 7 % 1000 + 60) AS parcel_id FROM customer""")
def q_parcels_at(spark: SparkSession, d: str) -> DataFrame:
    """The parcel each point lies in: points made of customers, parcels of suppliers."""
    points = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    y0 = (F.col("s_suppkey") * 7 % 1000).cast("double")
    parcels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("parcel_id"), F.col("s_acctbal").alias("x0"), y0.alias("y0"), (F.col("s_acctbal") + 300).alias("x1"), (y0 + 60).alias("y1"))
    return S.parcels_at(points, parcels, 200.0).select("c_custkey", "parcel_id")
