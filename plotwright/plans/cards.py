"""Queries of the serving side: one per condition of a card query, per order, and of the archive, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.operators import clusters as C
from plotwright.operators import views as V
from plotwright.plans.standins import DEV_SQL
from plotwright.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOME = (50.0, 19.0)
#: Places that count for a city, as districts do.
CITY_OF = {"Tlunybrowa": "Tłunybrowa", "TŁUNYBROWA": "Tłunybrowa", "m. Tłunybrowa": "Tłunybrowa"}


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Advertisements as cards: with the prices their address was seen at, whether it was seen again, and closed sightings as sales."""
    seen = table(spark, d, "observation").filter("url is not null").groupBy("url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", "obs_seq", "price"))), lambda s: s["price"]).alias("price_history"), (F.count(F.lit(1)) > 1).alias("relisted"),
        F.collect_list(F.when(F.col("status") == "archived", F.struct(F.lit("past").alias("kind"), "price"))).alias("sales"),
    )
    rows = table(spark, d, "listing").withColumn("development", C.is_developer(F.col("market"), F.col("title")))
    rows = rows.select("seq", "source", "type", "title", "price", "area", "price_per_m2", "rooms", "locality", "district", "created", "is_private", "development", "url")
    places = table(spark, d, "locality_ref").select(F.col("name").alias("town"), (F.lit(49.0) + F.col("loc_id") % 20 / F.lit(10.0)).alias("lat"), (F.lit(18.0) + F.col("loc_id") % 17 / F.lit(10.0)).alias("lon"))
    return V.with_distance(rows.join(seen, "url", "left"), places, HOME, CITY_OF)


_CITY = "CASE " + " ".join(f"WHEN locality = '{a}' THEN '{b}'" for a, b in CITY_OF.items()) + " ELSE nullif(locality, '') END"
_LAT, _LON = "(49.0 + loc_id % 20 / 10.0)::DOUBLE", "(18.0 + loc_id % 17 / 10.0)::DOUBLE"
_SEEN = """seen AS (SELECT url, list(price ORDER BY date NULLS FIRST, obs_seq NULLS FIRST, price NULLS FIRST) AS price_history, count(*) > 1 AS relisted, count(*) FILTER (WHERE status = 'archived') AS n_sales FROM observation WHERE url IS NOT NULL GROUP BY url)"""
_PLACES = f"places AS (SELECT name, CAST(floor(2 * 6371 * asin(sqrt(pow(sin(radians({_LAT} - 50.0) / 2), 2) + cos(radians(50.0)) * cos(radians({_LAT})) * pow(sin(radians({_LON} - 19.0) / 2), 2))) + 0.5) AS BIGINT) AS km FROM locality_ref)"
_CARDS = f"""WITH {_SEEN}, {_PLACES}, known AS (SELECT *, {_CITY} AS city, {DEV_SQL} AS development FROM listing),
    cards AS (SELECT known.*, price_history, list_filter(price_history, lambda p: p IS NOT NULL) AS prices, relisted, n_sales, km FROM known LEFT JOIN seen USING (url) LEFT JOIN places ON name = city)"""

#: Conditions one by one: the query, and what it means in SQL.
CONDITIONS = {
    "type": (V.CardQuery(type="house"), "type = 'house'"),
    "source": (V.CardQuery(source="gratka"), "source = 'gratka'"),
    "private": (V.CardQuery(owner="private"), "is_private IS TRUE"),
    "agency": (V.CardQuery(owner="agency"), "is_private IS FALSE"),
    "primary": (V.CardQuery(market="primary"), "development"),
    "secondary": (V.CardQuery(market="secondary"), "NOT development"),
    "relisted": (V.CardQuery(history="relisted"), "relisted"),
    "rcn": (V.CardQuery(history="rcn"), "n_sales > 0"),
    "dropped": (V.CardQuery(history="dropped"), "len(prices) > 1 AND prices[-1] < list_max(prices)"),
    "towns": (V.CardQuery(localities=("Tłunybrowa", "Prupatyń")), "city IN ('Tłunybrowa', 'Prupatyń')"),
    "distance": (V.CardQuery(distance="60"), "km <= 60"),
    "price": (V.CardQuery(min_price="300 000", max_price="450000 zł"), "price >= 300 AND price <= 450000"),
    "area": (V.CardQuery(min_area=45.5, max_area="60.5 m2"), "area >= 45.5::DOUBLE AND area <= 60.5::DOUBLE"),
    "rooms": (V.CardQuery(min_rooms=4), "rooms >= 4"),
    "no_number": (V.CardQuery(min_price="ask"), "true"),
    "text": (V.CardQuery(q=" Taras "), "contains(lower(coalesce(title, '') || ' ' || coalesce(locality, '') || ' ' || coalesce(district, '')), 'taras')"),
}

_PCT = "CASE WHEN price >= 10000 THEN (greatest(price, list_max(prices)) - price) / greatest(price, list_max(prices))::DOUBLE * 100 ELSE 0 END"
SORTS = {
    "newest": "nullif(created, '') DESC NULLS LAST", "discount": f"{_PCT} DESC", "price_asc": "price ASC NULLS LAST", "price_desc": "price DESC NULLS LAST",
    "ppm_asc": "price_per_m2 ASC NULLS LAST", "area_desc": "area DESC NULLS LAST",
}


def _condition(query: V.CardQuery):
    return lambda spark, d: V.run_query(_cards(spark, d), query, city_of=CITY_OF).select("seq")


def _sorted(sort: str):
    return lambda spark, d: V.page(V.run_query(_cards(spark, d), V.CardQuery(sort=sort)), 1).select("seq")


for _name, (_query, _sql) in CONDITIONS.items():
    QUERIES[f"q_filter_{_name}"] = _condition(_query)
    ORACLE[f"q_filter_{_name}"] = f"{_CARDS} SELECT seq FROM cards WHERE {_sql}"
for _name, _sql in SORTS.items():
    QUERIES[f"q_sort_{_name}"] = _sorted(_name)
    ORACLE[f"q_sort_{_name}"] = f"{_CARDS} SELECT seq FROM cards ORDER BY {_sql}, seq LIMIT 60 OFFSET 60"


def _archive(spark: SparkSession, d: str) -> DataFrame:
    """The stored archive; every third property with its last price as a confirmed sale, since the stored ones have none."""
    rows = table(spark, d, "archive_row").drop("sold")
    return rows.withColumn("sold", F.when(F.col("archive_id") % 3 == 0, F.struct(F.col("delisted").alias("date"), "price")))


def _archived(query: V.CardQuery):
    """The archive is a function here: other queries never read it."""
    return lambda spark, d: V.page(V.run_query(_cards(spark, d), query, lambda: _archive(spark, d)), 0).select("archive_id")


_DELISTED = "ORDER BY delisted DESC NULLS LAST, archive_id LIMIT 60"
for _name, _query, _sql in (
    ("archive_newest", V.CardQuery(history="sold"), f"WHERE true {_DELISTED}"),
    ("archive_sold", V.CardQuery(history="sold_rcn", owner="private", type="flat"), f"WHERE archive_id % 3 = 0 AND type = 'flat' {_DELISTED}"),
    ("archive_by_price", V.CardQuery(history="sold", sort="price_desc", market="secondary", min_rooms=3), "WHERE rooms >= 3 ORDER BY price DESC NULLS LAST, archive_id LIMIT 60"),
):
    QUERIES[f"q_{_name}"] = _archived(_query)
    ORACLE[f"q_{_name}"] = f"SELECT archive_id FROM archive_row {_sql}"


def q_facets_city(spark: SparkSession, d: str) -> DataFrame:
    """Cards by city, districts counted for theirs."""
    return V.facets(table(spark, d, "listing"), "locality", CITY_OF, "pl")


ORACLE["q_facets_city"] = f"SELECT {_CITY} AS value, count(*) AS n FROM listing WHERE {_CITY} IS NOT NULL GROUP BY 1"


def q_distance(spark: SparkSession, d: str) -> DataFrame:
    """Kilometres from home to the towns whose place is known."""
    return _cards(spark, d).filter("distance_km is not null").select("seq", "distance_km")


ORACLE["q_distance"] = f"{_CARDS} SELECT seq, km AS distance_km FROM cards WHERE km IS NOT NULL"


def q_lines(spark: SparkSession, d: str) -> DataFrame:
    """What an archived property's card says: banner, whether its timeline is shown, its price label."""
    rows = _archive(spark, d)
    sales = F.when(F.col("sold").isNotNull(), F.array(F.struct(F.lit("sold").alias("kind"), F.col("sold.price").alias("price"))))
    return rows.select("archive_id", V.banner(sales, F.col("delisted")).alias("banner"), V.timeline_shown(F.col("timeline"), F.col("photo_urls"), sales).alias("shown"), V.price_label(F.col("price"), F.array_max(F.transform("timeline", lambda e: e["price"]))).alias("label"))


ORACLE["q_lines"] = """SELECT archive_id, CASE WHEN archive_id % 3 = 0 AND price > 0 THEN 'sold ' || price ELSE 'gone ' || delisted END AS banner, coalesce(len(timeline), 0) >= 2 OR coalesce(len(photo_urls), 0) > 0 OR archive_id % 3 = 0 AS shown,
    CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM price THEN concat_ws(' - ', price::VARCHAR, top::VARCHAR) ELSE price::VARCHAR END AS label FROM (SELECT *, list_max(list_transform(timeline, lambda e: e.price)) AS top FROM archive_row)"""
QUERIES |= {"q_facets_city": q_facets_city, "q_distance": q_distance, "q_lines": q_lines}
