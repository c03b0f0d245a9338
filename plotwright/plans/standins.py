"""Queries over the test tables for the engine's operators, each with equivalent SQL.

Tables of the engine's own kind (listing, observation, deed, archive_row, match_pair, dup_group) are used where
there are any, the general ones elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.functions import addresses as A
from plotwright.functions import numbers as N
from plotwright.functions.photos import hamming
from plotwright.functions.text import _MARKED, _PLAIN, fold_words
from plotwright.operators import clusters as C
from plotwright.operators import deeds as D
from plotwright.operators import history as H
from plotwright.operators import state as S
from plotwright.operators import views as V
from plotwright.operators.components import connected_components
from plotwright.session import table
from plotwright.sources import portals as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FOLD = f"translate(lower({{}}), '{_MARKED}', '{_PLAIN}')"
RANK_SQL = "CASE source WHEN 'otodom' THEN 0 WHEN 'nieruchomosci-online' THEN 1 WHEN 'gratka' THEN 2 WHEN 'olx' THEN 3 ELSE 9 END"
OFFER_ORDER = f"(CASE WHEN image IS NULL OR image = '' THEN 1 ELSE 0 END), {RANK_SQL}, coalesce(price::DOUBLE, 'inf'::DOUBLE), seq"
DEV_SQL = "(coalesce(market, '') LIKE 'primary%' OR coalesce(market, '') LIKE 'pierwotn%' OR regexp_matches(coalesce(title, ''), '(?i)deweloper|inwestycj|rynek\\s+pierwotn|nowe\\s+osiedle|stan\\s+deweloperski|etap\\s+[ivx0-9]'))"
KEY_SQL = "type, CAST(round_even(area * 100, 0) AS BIGINT) AS k_area, CASE WHEN type = 'house' THEN NULL ELSE rooms END AS k_rooms, CASE WHEN area IS NULL THEN seq END AS k_alone"


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Grouping and clustering


@query(
    """WITH RECURSIVE s AS (SELECT o_custkey k, o_orderkey o, o_totalprice p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) n FROM orders),
    r AS (SELECT k, o, p, n, p AS start, 0 AS part FROM s WHERE n = 1
      UNION ALL SELECT s.k, s.o, s.p, s.n, CASE WHEN s.p > r.start * 1.15::DOUBLE THEN s.p ELSE r.start END, CASE WHEN s.p > r.start * 1.15::DOUBLE THEN r.part + 1 ELSE r.part END FROM r JOIN s ON s.k = r.k AND s.n = r.n + 1)
    SELECT k AS o_custkey, part::BIGINT AS part, count(*) AS n_offers, min(p) AS min_price, max(p) AS max_price, min(o) AS first_order FROM r GROUP BY 1, 2"""
)
def q_price_spread(spark: SparkSession, d: str) -> DataFrame:
    """Greedy price clusters of each customer's orders."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    parts = C.split_by_price(rows, ["o_custkey"], "o_totalprice")
    return parts.groupBy("o_custkey", F.col("part").cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("n_offers"), F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"), F.min("o_orderkey").alias("first_order"))


@query(f"SELECT type, k_area, k_rooms, count(*) AS n, count(price) AS priced, min(price) AS cheapest FROM (SELECT {KEY_SQL}, price FROM listing) GROUP BY type, k_area, k_rooms, k_alone")
def q_size_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Advertisements per size; those without area stand alone."""
    rows = table(spark, d, "listing").select("price", *C.size_key())
    return rows.groupBy(*C.KEY).agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.min("price").alias("cheapest")).select(F.col("k_type").alias("type"), "k_area", "k_rooms", "n", "priced", "cheapest")


_PAIRS_SQL = f"""ph AS (SELECT seq, type, k_area, k_rooms, k_alone, unnest(phashes) AS h FROM (SELECT seq, phashes, {KEY_SQL} FROM listing)),
    pairs AS (SELECT DISTINCT x.seq AS a, y.seq AS b FROM ph x JOIN ph y ON x.type IS NOT DISTINCT FROM y.type AND x.k_area IS NOT DISTINCT FROM y.k_area AND x.k_rooms IS NOT DISTINCT FROM y.k_rooms AND x.k_alone IS NOT DISTINCT FROM y.k_alone AND x.seq < y.seq
      WHERE bit_count(xor(x.h[1], y.h[1]))::INT + bit_count(xor(x.h[2], y.h[2]))::INT + bit_count(xor(x.h[3], y.h[3]))::INT + bit_count(xor(x.h[4], y.h[4]))::INT <= 40)"""


@query(f"WITH {_PAIRS_SQL} SELECT a, b FROM pairs")
def q_photo_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Advertisements of one size with a photo in common."""
    return C.photo_pairs(table(spark, d, "listing").select("seq", "phashes", *C.size_key()), C.KEY)


@query(f"""WITH RECURSIVE {_PAIRS_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a) SELECT v, min(u) AS comp FROM r GROUP BY v""")
def q_photo_components(spark: SparkSession, d: str) -> DataFrame:
    """Photo pairs closed transitively."""
    return connected_components(q_photo_pairs(spark, d))


@query(
    """WITH RECURSIVE e AS (SELECT x.vec_id a, y.vec_id b FROM (SELECT vec_id, label, list_transform(embedding, lambda z: CASE WHEN z > 0 THEN 1 ELSE 0 END) s FROM embeddings) x JOIN (SELECT vec_id, label, list_transform(embedding, lambda z: CASE WHEN z > 0 THEN 1 ELSE 0 END) s FROM embeddings) y
      ON x.label = y.label AND x.vec_id < y.vec_id WHERE 64 - 2 * list_dot_product(x.s::DOUBLE[], y.s::DOUBLE[]) + list_sum(x.s) + list_sum(y.s) - 64 <= 22),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a v, a u FROM s UNION SELECT r.v, s.b FROM r JOIN s ON r.u = s.a) SELECT v AS vec_id, min(u) AS comp FROM r GROUP BY v"""
)
def q_sign_components(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of a label whose sign bits differ in at most 22 places, closed transitively."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: F.when(F.get("embedding", i) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(acc))
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.array(bits).alias("h"))
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.vec_id") < F.col("y.vec_id")) & (hamming(F.col("x.h"), F.col("y.h"), 1) <= 22)).select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"))
    return connected_components(pairs).withColumnRenamed("v", "vec_id")


@query(f"""SELECT type, k_area, k_rooms, (bool_or(dev) OR max(n) >= 3) AS developer FROM (SELECT type, k_area, k_rooms, k_alone, source, count(DISTINCT source_id) n, bool_or(dev) dev
    FROM (SELECT {KEY_SQL}, source, source_id, {DEV_SQL} AS dev FROM listing) GROUP BY ALL) GROUP BY type, k_area, k_rooms, k_alone""")
def q_developer_flags(spark: SparkSession, d: str) -> DataFrame:
    """Size blocks that read like a developer's offer."""
    rows = table(spark, d, "listing").select("source", "source_id", "market", "title", *C.size_key())
    return C.developer_flags(rows, C.KEY).select(F.col("k_type").alias("type"), "k_area", "k_rooms", "developer")


_FIRST = ", ".join(f"first({c} ORDER BY {OFFER_ORDER}) FILTER (WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '') AS {c}" for c in C.DISPLAY)


@query(f"""SELECT source || '|' || source_id AS cluster, min(seq) AS seq, {_FIRST}, min(price) AS price, max(price) AS price_max, max(created) AS created, first(url ORDER BY {OFFER_ORDER}) AS url,
    first(price_per_m2 ORDER BY {OFFER_ORDER}) AS price_per_m2, count(DISTINCT coalesce(url, '')) AS n_offers FROM listing WHERE source IS NOT NULL AND source_id IS NOT NULL GROUP BY 1""")
def q_cards(spark: SparkSession, d: str) -> DataFrame:
    """One card per advertisement, out of its repeated scans."""
    rows = table(spark, d, "listing").filter("source is not null and source_id is not null").withColumns({"cluster": F.concat_ws("|", "source", "source_id"), "developer": F.lit(False)})
    cards = C.build_cards(rows)
    return cards.select("cluster", "seq", *C.DISPLAY, "price", "price_max", "created", "url", "price_per_m2", F.size("offers").cast("bigint").alias("n_offers"))


@query("""WITH g AS (SELECT *, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS cents FROM part), s AS (SELECT p_type, p_size, p_brand, count(DISTINCT p_name) n FROM g GROUP BY ALL HAVING count(DISTINCT p_name) BETWEEN 2 AND 3)
    SELECT g.p_partkey, s.n, (SELECT min(o.cents) FROM g o WHERE o.p_type = g.p_type AND o.p_size = g.p_size AND o.p_brand = g.p_brand AND o.p_name <> g.p_name) AS other_price FROM g JOIN s USING (p_type, p_size, p_brand)""")
def q_same_size_link(spark: SparkSession, d: str) -> DataFrame:
    """Parts of two or three different names that share type, size and brand, with the cheapest other price."""
    keys = ["p_type", "p_size", "p_brand"]
    g = table(spark, d, "part").withColumn("cents", F.bround(F.col("p_retailprice") * 100, 0).cast("bigint"))
    s = g.groupBy(*keys).agg(F.countDistinct("p_name").alias("n"), F.collect_list(F.struct("p_name", "cents")).alias("all")).filter("n between 2 and 3")
    return g.join(s, keys).select("p_partkey", "n", F.array_min(F.transform(F.filter("all", lambda o: o["p_name"] != F.col("p_name")), lambda o: o["cents"])).alias("other_price"))


@query("SELECT l_partkey, count(*) AS n_offers, min(l_extendedprice) AS price, max(l_extendedprice) AS price_max, arg_min(l_suppkey, l_extendedprice * 1e7 + l_orderkey + l_linenumber / 10.0) AS cheapest FROM lineitem GROUP BY 1")
def q_offer_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Price range and cheapest supplier of each part."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_offers"), F.min("l_extendedprice").alias("price"), F.max("l_extendedprice").alias("price_max"), F.min_by("l_suppkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("cheapest"))


# Sighting log

_LIVE = "coalesce(status, '') <> 'archived'"
_FIRST_URL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, url ORDER BY date NULLS FIRST, obs_seq NULLS FIRST, price NULLS FIRST) k FROM observation WHERE {_LIVE}) WHERE k = 1"
_KINDS = f"SELECT record_id, obs_seq, date, price, url, source, CASE WHEN row_number() OVER (PARTITION BY record_id ORDER BY date NULLS FIRST, obs_seq NULLS FIRST, url NULLS FIRST) = 1 THEN 'listed' ELSE 'relist' END AS kind FROM ({_FIRST_URL})"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observation")


@query("""SELECT record_id, obs_seq, date, price FROM (SELECT *, row_number() OVER w n, lag(price) OVER w p FROM observation WINDOW w AS (PARTITION BY record_id ORDER BY obs_seq NULLS FIRST, date NULLS FIRST, url NULLS FIRST)) WHERE n = 1 OR price IS DISTINCT FROM p""")
def q_price_trail(spark: SparkSession, d: str) -> DataFrame:
    """Sightings with a price other than the one before."""
    return H.price_trail(_log(spark, d)).select("record_id", "obs_seq", "date", "price")


@query(f"""SELECT record_id, obs_seq, date, url, price, before FROM (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY record_id, url ORDER BY date NULLS FIRST, obs_seq NULLS FIRST, price NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM observation WHERE {_LIVE}) WHERE price IS NOT NULL AND before IS NOT NULL AND price <> before""")
def q_url_price_change(spark: SparkSession, d: str) -> DataFrame:
    """Price changes of one address."""
    return H.url_price_changes(_log(spark, d)).select("record_id", "obs_seq", "date", "url", "price", "before")


@query(f"SELECT record_id, url, date, kind FROM ({_KINDS})")
def q_listed_relist(spark: SparkSession, d: str) -> DataFrame:
    """First sighting of each address of a record."""
    return H.listings_and_relists(_log(spark, d)).select("record_id", "url", "date", "kind")


@query("SELECT record_id, date, obs_seq FROM (SELECT *, row_number() OVER (PARTITION BY record_id, date, url ORDER BY obs_seq NULLS FIRST) k FROM observation) WHERE k = 1")
def q_observe_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One sighting of an address a day."""
    return H.first_sightings(_log(spark, d), ["record_id", "date", "url"], ["obs_seq"]).select("record_id", "date", "obs_seq")


@query("SELECT record_id, min(date) AS first_seen, max(date) AS last_seen, count(*) AS sightings FROM observation GROUP BY 1")
def q_seen_span(spark: SparkSession, d: str) -> DataFrame:
    return H.seen_span(_log(spark, d))


@query("SELECT record_id, max(date) AS last_date, count(DISTINCT url) AS urls, count(DISTINCT source) AS sources FROM observation GROUP BY 1")
def q_record_sources(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("record_id").agg(F.max("date").alias("last_date"), F.countDistinct("url").alias("urls"), F.countDistinct("source").alias("sources"))


@query(f"""WITH ev AS (SELECT record_id, date, kind, price, url, 1 AS b, obs_seq FROM ({_KINDS})
      UNION ALL SELECT record_id, date, 'price', price, url, 2, obs_seq FROM (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY record_id, url ORDER BY date NULLS FIRST, obs_seq NULLS FIRST, price NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM observation WHERE {_LIVE}) WHERE price IS NOT NULL AND before IS NOT NULL AND price <> before
      UNION ALL SELECT record_id, date, 'archived', price, url, 3, obs_seq FROM observation WHERE status = 'archived'),
    n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY date NULLS FIRST, b, obs_seq NULLS FIRST, kind, url NULLS FIRST) AS k, count(*) OVER (PARTITION BY record_id) AS total FROM ev)
    SELECT record_id, k::BIGINT AS n, date, kind, price FROM n WHERE total <= 5 OR k <= 2 OR k > total - 3""")
def q_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Events of each record in order, the first two and the last three of long ones."""
    return H.timelines(H.timeline_events(_log(spark, d)), 2, 3).select("record_id", F.col("n").cast("bigint").alias("n"), "date", "kind", "price")


@query("""WITH l AS (SELECT record_id, max(date) AS m FROM observation GROUP BY 1), t AS (SELECT max(date) AS today FROM observation)
    SELECT url, max(record_id) AS record_id FROM observation WHERE url IS NOT NULL GROUP BY url""")
def q_url_index(spark: SparkSession, d: str) -> DataFrame:
    """The record each address belongs to."""
    return H.url_index(_log(spark, d))


@query("""WITH t AS (SELECT max(date) AS today FROM observation), a AS (SELECT DISTINCT url FROM observation, t WHERE date = today AND url IS NOT NULL), live AS (SELECT DISTINCT record_id FROM observation WHERE url IN (SELECT url FROM a)),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY date DESC NULLS LAST, obs_seq, url) k FROM observation) WHERE k = 1)
    SELECT record_id, date FROM l, t WHERE record_id NOT IN (SELECT record_id FROM live) AND date < today - 7 AND url IS NOT NULL ORDER BY date, url, record_id LIMIT 50""")
def q_stale_topn(spark: SparkSession, d: str) -> DataFrame:
    """The fifty records longest unseen: a report of bounded size."""
    log = _log(spark, d)
    one = log.groupBy("record_id", "date", "obs_seq").agg(F.min(F.struct(F.col("url").isNull().alias("n"), "url", "source", "price", "status")).alias("r")).select("record_id", "date", "obs_seq", "r.url", "r.source", "r.price", "r.status")
    today = log.agg(F.max("date").alias("today"))
    active = log.join(today, F.col("date") == F.col("today")).select("url").filter("url is not null")
    last_day = today.first()["today"]
    return H.stale_records(one, active, F.lit(last_day), 7, 50).select("record_id", "date")


@query("""WITH cut AS (SELECT date_trunc('day', max(ts)) - INTERVAL 10 DAY AS c FROM events), o AS (SELECT user_id, max(ts)::DATE AS seen, arg_max(value, event_id) AS v FROM events, cut WHERE ts < c GROUP BY 1), n AS (SELECT user_id, max(ts)::DATE AS seen, arg_max(value, event_id) AS v FROM events, cut WHERE ts >= c GROUP BY 1)
    SELECT user_id, seen, v FROM n UNION ALL SELECT user_id, seen, v FROM o WHERE user_id NOT IN (SELECT user_id FROM n) AND seen >= (SELECT c FROM cut)::DATE - 21""")
def q_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A cache of the latest value per user: new entries replace, entries unseen for 21 days expire."""
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    cut = ev.agg((F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 10 DAYS")).alias("c")).first()["c"]
    latest = lambda rows: rows.groupBy("user_id").agg(F.max("ts").cast("date").alias("seen"), F.max_by("value", "event_id").alias("v"))
    old, new = latest(ev.filter(F.col("ts") < F.lit(cut))), latest(ev.filter(F.col("ts") >= F.lit(cut)))
    return H.expire(H.upsert(old, new, "user_id"), F.lit(cut).cast("date"), 21)


@query("""WITH cut AS (SELECT date_trunc('day', max(ts)) - INTERVAL 10 DAY AS c FROM events), o AS (SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events, cut WHERE ts < c GROUP BY 1),
    n AS (SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) FILTER (WHERE value > 80) AS v FROM events, cut WHERE ts >= c GROUP BY 1)
    SELECT user_id, coalesce(n.t, o.t) AS t, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (user_id)""")
def q_snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot fields of users after a new run: the new value unless it is missing."""
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "value", "event_type")
    cut = ev.agg((F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 10 DAYS")).alias("c")).first()["c"]
    old = ev.filter(F.col("ts") < F.lit(cut)).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max_by("value", "event_id").alias("v"))
    new = ev.filter(F.col("ts") >= F.lit(cut)).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max_by("value", F.when(F.col("value") > 80, F.col("event_id"))).alias("v"))
    return H.merge_snapshot(old, new, "user_id", ["t", "v"])


# Deeds


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE abs(s_acctbal - c_acctbal) <= 200")
def q_deed_band_join(spark: SparkSession, d: str) -> DataFrame:
    """Equal nation, balances at most 200 apart: an equi-join over bins."""
    return D.band_candidates(table(spark, d, "supplier"), table(spark, d, "customer"), [("s_nationkey", "c_nationkey")], ("s_acctbal", "c_acctbal"), 200).select("s_suppkey", "c_custkey")


_TOWN = f"trim(regexp_replace({FOLD}, '[^a-z0-9 ]', ' ', 'g'))"
_CAND = f"""t AS (SELECT DISTINCT {_TOWN.format("msc")} AS town FROM deed WHERE msc IS NOT NULL AND {_TOWN.format("msc")} <> ''),
    r AS (SELECT a.*, coalesce(t1.town, t2.town) AS town FROM archive_row a LEFT JOIN t t1 ON {_TOWN.format("a.locality")} = t1.town LEFT JOIN t t2 ON {_TOWN.format("a.district")} = t2.town),
    c AS (SELECT archive_id, deed_id, first_seen, delisted, d.d AS day, d.c AS paid, d.a AS size FROM r JOIN (SELECT *, {_TOWN.format("msc")} AS town FROM deed) d ON r.town = d.town AND r.type = d.kind WHERE abs(r.area - d.a) <= 0.6::DOUBLE)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "archive_row").select("archive_id", "type", "area", "locality", "district", "first_seen", "delisted")
    deeds = table(spark, d, "deed").select("deed_id", "kind", "d", "c", "a", "msc")
    left = D.town_of_record(records, deeds).filter("town is not null")
    return D.band_candidates(left, deeds.withColumn("deed_town", A.plain(F.col("msc"))), [("town", "deed_town"), ("type", "kind")], ("area", "a"), 0.6)


@query(f"WITH {_CAND} SELECT archive_id, deed_id FROM c")
def q_deed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Deeds of a property's kind and town with an area at most 0.6 off."""
    return _candidates(spark, d).select("archive_id", "deed_id")


@query(f"""WITH {_CAND} SELECT archive_id, deed_id, 'past' AS kind, CAST(round_even(paid / size, 0) AS BIGINT) AS price_m2 FROM c WHERE day <= first_seen - 1 OR first_seen IS NULL
    UNION ALL SELECT archive_id, deed_id, 'sold', CAST(round_even(paid / size, 0) AS BIGINT) FROM c WHERE day BETWEEN delisted - 60 AND delisted + 400""")
def q_deed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Candidates before the first sighting and around the delisting, with the price of a square metre."""
    c = _candidates(spark, d).withColumn("sale", F.explode(D.sale_windows(F.col("d"), F.col("first_seen"), F.col("delisted"))))
    return c.select("archive_id", "deed_id", F.col("sale").alias("kind"), N.price_per_m2(F.col("c"), F.col("a")).alias("price_m2"))


@query(f"""WITH {_CAND}, m AS (SELECT archive_id, count(*) AS n FROM c GROUP BY 1) SELECT CASE WHEN r.town IS NULL THEN 'no_location' WHEN m.n IS NULL THEN 'no_candidates' WHEN m.n = 1 THEN 'unique' ELSE 'several' END AS stage, count(*) AS n FROM r LEFT JOIN m USING (archive_id) GROUP BY 1""")
def q_match_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How far archived properties come towards a deed."""
    n = _candidates(spark, d).groupBy("archive_id").agg(F.count(F.lit(1)).alias("n"))
    records = D.town_of_record(table(spark, d, "archive_row").select("archive_id", "locality", "district"), table(spark, d, "deed").select("msc"))
    stage = F.when(F.col("town").isNull(), "no_location").when(F.col("n").isNull(), "no_candidates").when(F.col("n") == 1, "unique").otherwise("several")
    return records.join(n, "archive_id", "left").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT deed_id, d, c, ul FROM deed WHERE {_TOWN.format('msc')} = 'tlunybrowa' AND kind = 'flat' AND abs(a - 50) <= 5 ORDER BY d, c")
def q_deed_search(spark: SparkSession, d: str) -> DataFrame:
    """Flats of about 50 square metres sold in one town."""
    return D.search_deeds(table(spark, d, "deed"), "Tłunybrowa", 50.0, 5.0, kind="flat").select("deed_id", "d", "c", "ul")


@query("SELECT kind, msc, count(*) AS n, min(c) AS lowest, max(c) AS highest FROM (SELECT DISTINCT kind, d, c, a, izb, kond, grunt, rynek, msc, ul, nr, dz FROM deed) GROUP BY 1, 2")
def q_deed_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Deeds without repetitions, by kind and town."""
    return table(spark, d, "deed").drop("deed_id").dropDuplicates().groupBy("kind", "msc").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lowest"), F.max("c").alias("highest"))


_TITLE_STREET = "(?i)(?:^|[ ,|])(?:ul[.]?|ulica|al[.]?|aleja|pl[.]?|plac|os[.]?) *([^,|]+)"
_NOISE = ", ".join(f"'{w}'" for w in A.STREET_NOISE)
_WORDS = "list_filter(regexp_split_to_array(trim(regexp_replace(" + FOLD + r", '[^a-z0-9 ]', ' ', 'g')), '\s+'), lambda t: t <> '' AND t NOT IN (" + _NOISE + ") AND NOT regexp_full_match(t, '[0-9]+'))"
_SHORT, _LONG = "least(length({0}), length({1}))", "greatest(length({0}), length({1}))"
_COMMON = f"CASE WHEN left({{0}}, {_SHORT}) = left({{1}}, {_SHORT}) THEN {_SHORT} ELSE {_SHORT} - 1 END"
_EQ = f"({{0}} = {{1}} OR (left({{0}}, {_SHORT} - 1) = left({{1}}, {_SHORT} - 1) AND ({_COMMON}) >= 4 AND {_LONG} - ({_COMMON}) <= 3))"
_AGREE = f"(len(few) > 0 AND {_EQ.format('few[-1]', 'many[-1]')} AND len(list_filter(few[:-2], lambda t: len(list_filter(many, lambda u: {_EQ.format('t', 'u')})) = 0)) = 0)"
_CARDS = f"""t AS (SELECT DISTINCT {_TOWN.format("msc")} AS town FROM deed WHERE msc IS NOT NULL AND {_TOWN.format("msc")} <> ''),
    r AS (SELECT a.*, coalesce(regexp_extract(title, '{_TITLE_STREET}', 1), '') AS street, coalesce(t1.town, t2.town) AS town FROM archive_row a LEFT JOIN t t1 ON {_TOWN.format("a.locality")} = t1.town LEFT JOIN t t2 ON {_TOWN.format("a.district")} = t2.town),
    c AS (SELECT archive_id, type, area, rooms, first_seen, delisted, d.*, street <> '' AND coalesce(ul, '') <> '' AS told, {_WORDS.format("street")} AS wa, {_WORDS.format("coalesce(ul, '')")} AS wb, count(*) OVER (PARTITION BY archive_id) = 1 AND abs(area - round_even(area, 0)) > 0.01 AS alone
      FROM r JOIN (SELECT *, {_TOWN.format("msc")} AS town FROM deed) d ON r.town = d.town AND r.type = d.kind WHERE abs(r.area - d.a) <= 0.6::DOUBLE),
    f AS (SELECT *, CASE WHEN len(wa) <= len(wb) THEN wa ELSE wb END AS few, CASE WHEN len(wa) <= len(wb) THEN wb ELSE wa END AS many FROM c),
    s AS (SELECT *, CASE WHEN told THEN CASE WHEN {_AGREE} THEN 2 ELSE 0 END WHEN type = 'flat' AND rooms <> izb THEN 0 WHEN alone THEN 1 ELSE 0 END AS score FROM f),
    w AS (SELECT *, 'past' AS sale FROM s WHERE score > 0 AND (first_seen IS NULL OR d <= first_seen - 1) UNION ALL SELECT *, 'sold' FROM s WHERE score > 0 AND d BETWEEN delisted - 60 AND delisted + 400),
    b AS (SELECT *, count(*) OVER (PARTITION BY archive_id, sale) AS n FROM (SELECT *, max(score) OVER (PARTITION BY archive_id, sale) AS top FROM w) WHERE score = top)"""


@query(f"""WITH {_CARDS} SELECT archive_id, sale AS kind, d, c AS price, CAST(round_even(c / a, 0) AS BIGINT) AS price_m2, score FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, d, c ORDER BY sale) AS k FROM b WHERE (sale = 'sold' AND n = 1) OR (sale = 'past' AND n <= 3)) WHERE k = 1""")
def q_match_deeds(spark: SparkSession, d: str) -> DataFrame:
    """Deeds attached to archived properties: scored candidates, the best of each window, unique sales."""
    none = lambda t: F.lit(None).cast(t)
    records = table(spark, d, "archive_row").select(
        F.col("archive_id").alias("record_id"), "type", "area", "locality", "district", F.regexp_extract(F.coalesce("title", F.lit("")), _TITLE_STREET, 1).alias("street"), none("string").alias("nr"), none("string").alias("dzialka_id"),
        "rooms", none("int").alias("floor_no"), none("double").alias("plot_area"), "first_seen", "delisted",
    )
    got = D.match_deeds(records, table(spark, d, "deed"))
    return got.select(F.col("record_id").alias("archive_id"), "kind", "d", "price", "price_m2", F.col("score").alias("score"))


# Scalars


@query(f"SELECT seq, trim(regexp_replace({FOLD.format('street')}, '[^a-z0-9]+', ' ', 'g')) AS folded FROM listing WHERE street IS NOT NULL")
def q_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listing").filter("street is not null").select("seq", fold_words(F.col("street")).alias("folded"))


@query(f"SELECT seq, array_to_string({_WORDS.format('street')}, ' ') AS words FROM listing WHERE street IS NOT NULL")
def q_street_words(spark: SparkSession, d: str) -> DataFrame:
    """Telling words of street names."""
    return table(spark, d, "listing").filter("street is not null").select("seq", F.array_join(A.street_words(F.col("street")), " ").alias("words"))


@query(f"""WITH w AS (SELECT DISTINCT left({FOLD.format("ul")}, 4) AS k, ul, {_WORDS.format("ul")} AS ws FROM deed WHERE ul IS NOT NULL), p AS (SELECT x.ul AS a, y.ul AS b, CASE WHEN len(x.ws) <= len(y.ws) THEN x.ws ELSE y.ws END AS few, CASE WHEN len(x.ws) <= len(y.ws) THEN y.ws ELSE x.ws END AS many FROM w x JOIN w y ON x.k = y.k AND x.ul < y.ul WHERE len(x.ws) > 0 AND len(y.ws) > 0)
    SELECT a, b FROM p WHERE {_EQ.format("few[-1]", "many[-1]")} AND len(list_filter(few[:-2], lambda t: len(list_filter(many, lambda u: {_EQ.format("t", "u")})) = 0)) = 0""")
def q_street_match(spark: SparkSession, d: str) -> DataFrame:
    """Street names of deeds with one beginning that are the same street."""
    w = table(spark, d, "deed").filter("ul is not null").select("ul").distinct().select("ul", F.left(A.fold(F.col("ul")), F.lit(4)).alias("k"), A.street_words(F.col("ul")).alias("ws"))
    x, y = w.alias("x"), w.alias("y")
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.ul") < F.col("y.ul")))
    return met.filter(A.word_lists_agree(F.col("x.ws"), F.col("y.ws"))).select(F.col("x.ul").alias("a"), F.col("y.ul").alias("b"))


@query()
def q_same_streets(spark: SparkSession, d: str) -> DataFrame:
    """All street names of deeds that are the same street, whatever they begin with (no SQL; :func:`q_street_match` keeps to names with one beginning, as its SQL does)."""
    w = table(spark, d, "deed").filter("ul is not null").select("ul").distinct().select("ul", A.street_words(F.col("ul")).alias("ws"))
    # Last words that agree are equal or have their first four letters in common.
    w = w.filter(F.size("ws") > 0).withColumn("k", F.left(F.element_at("ws", -1), F.lit(4)))
    x, y = w.alias("x"), w.alias("y")
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.ul") < F.col("y.ul")))
    return met.filter(A.word_lists_agree(F.col("x.ws"), F.col("y.ws"))).select(F.col("x.ul").alias("a"), F.col("y.ul").alias("b"))


@query("SELECT seq, CASE lower(trim(floor)) WHEN 'parter' THEN 0 WHEN 'suterena' THEN -1 WHEN 'poddasze' THEN NULL ELSE TRY_CAST(regexp_extract(lower(trim(floor)), '(-?[0-9]+)', 1) AS INTEGER) END AS floor_no FROM listing WHERE floor IS NOT NULL")
def q_floor_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listing").filter("floor is not null").select("seq", N.floor_number(F.col("floor")).alias("floor_no"))


@query("SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS n FROM orders")
def q_to_number(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in Polish style and read again."""
    text = F.concat(F.regexp_replace(F.format_number("o_totalprice", 2), ",", chr(0xA0)), F.lit(" zł"))
    polish = F.regexp_replace(text, r"\.(\d\d) zł", ",$1 zł za całość")
    return table(spark, d, "orders").select("o_orderkey", N.price_before_unit(polish).alias("n"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_LAT, _LON = "(49.0 + s_suppkey % 20 / 10.0)::DOUBLE", "(18.0 + s_suppkey % 17 / 10.0)::DOUBLE"


@query(f"SELECT s_suppkey, CAST(floor(2 * 6371 * asin(sqrt(pow(sin(radians({_LAT} - 50.0) / 2), 2) + cos(radians(50.0)) * cos(radians({_LAT})) * pow(sin(radians({_LON} - 19.0) / 2), 2))) + 0.5) AS BIGINT) AS km FROM supplier")
def q_haversine(spark: SparkSession, d: str) -> DataFrame:
    """Distances of points built from supplier keys."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.lit(49.0) + F.col("s_suppkey") % 20 / F.lit(10.0)).alias("lat"), (F.lit(18.0) + F.col("s_suppkey") % 17 / F.lit(10.0)).alias("lon"))
    return s.select("s_suppkey", N.haversine_km(F.lit(50.0), F.lit(19.0), F.col("lat"), F.col("lon")).alias("km"))


@query(f"SELECT archive_id, {FOLD.format('title')} LIKE '%ul%' AS named, abs(area - round_even(area, 0)) > 0.01 AS fine, CAST(round_even(area, 0) AS BIGINT) AS bucket FROM archive_row WHERE title IS NOT NULL")
def q_area_flags(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "archive_row").filter("title is not null")
    return a.select("archive_id", F.contains(A.fold(F.col("title")), F.lit("ul")).alias("named"), N.has_decimals(F.col("area")).alias("fine"), N.area_bucket(F.col("area")).alias("bucket"))


@query("SELECT seq, array_to_string(list_filter(list_transform(string_split(replace(locality, 'śląskie', ''), ','), lambda p: trim(p, ' ')), lambda p: p <> '')[-1:], '') AS town, len(list_filter(list_transform(string_split(replace(locality, 'śląskie', ''), ','), lambda p: trim(p, ' ')), lambda p: p <> '')) AS parts FROM listing WHERE locality IS NOT NULL")
def q_place_parts(spark: SparkSession, d: str) -> DataFrame:
    """Breadcrumb parts of places."""
    rows = table(spark, d, "listing").filter("locality is not null")
    return rows.select("seq", F.coalesce(A.town_of_place(F.col("locality")), F.lit("")).alias("town"), F.size(A.place_parts(F.col("locality"))).cast("bigint").alias("parts"))


# Serving


@query("""SELECT seq, price, area FROM listing WHERE type = 'flat' AND is_private IS TRUE AND price >= 200000 AND price <= 600000 AND rooms >= 2 AND contains(lower(coalesce(title, '') || ' ' || coalesce(locality, '') || ' ' || coalesce(district, '')), 'taras')""")
def q_filter_cards(spark: SparkSession, d: str) -> DataFrame:
    """Private flats of a price range with a word in their texts."""
    q = V.CardQuery(type="flat", owner="private", min_price=200000, max_price="600000", min_rooms=2, q="Taras")
    return V.run_query(table(spark, d, "listing").drop("phashes", "photo_urls"), q).select("seq", "price", "area")


@query("SELECT seq, price FROM listing ORDER BY price ASC NULLS LAST, seq LIMIT 60 OFFSET 120")
def q_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of sixty by price."""
    return V.page(V.ordered(table(spark, d, "listing").select("seq", "price"), "price_asc"), 2)


@query("SELECT source AS value, count(*) AS n FROM listing WHERE source IS NOT NULL GROUP BY 1")
def q_facets(spark: SparkSession, d: str) -> DataFrame:
    return V.facets(table(spark, d, "listing"), "source")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(photo_urls) AS value FROM listing) WHERE value IS NOT NULL GROUP BY 1")
def q_photo_facets(spark: SparkSession, d: str) -> DataFrame:
    """How many advertisements show each photo address."""
    return V.facets(table(spark, d, "listing").select("photo_urls"), "photo_urls")


@query("SELECT count(*) AS \"rows\", count(*) FILTER (WHERE type = 'house') AS houses, count(*) FILTER (WHERE type = 'flat') AS flats, count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE is_private) AS private, count(*) FILTER (WHERE price > 0) AS priced FROM listing")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(table(spark, d, "listing"))


@query("""SELECT record_id, highest, last_price, CASE WHEN last_price >= 10000 THEN highest - last_price ELSE 0 END AS off, round(CASE WHEN last_price >= 10000 THEN (highest - last_price) / highest::DOUBLE * 100 ELSE 0 END, 4) AS pct FROM
    (SELECT record_id, max(price) AS highest, arg_max(price, obs_seq * 10000000 + price) FILTER (WHERE price IS NOT NULL) AS last_price FROM observation GROUP BY 1) WHERE last_price IS NOT NULL""")
def q_discount(spark: SparkSession, d: str) -> DataFrame:
    """Last known price of a record against its highest."""
    g = _log(spark, d).groupBy("record_id").agg(F.max("price").alias("highest"), F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("obs_seq", "price"))).alias("last_price")).filter("last_price is not null")
    pct, off = V.discount(F.col("last_price"), F.col("highest"))
    return g.select("record_id", "highest", "last_price", off.alias("off"), F.round(pct, 4).alias("pct"))


@query("SELECT record_id, CASE WHEN lo IS DISTINCT FROM hi THEN lo::VARCHAR || ' - ' || hi::VARCHAR ELSE lo::VARCHAR END AS label FROM (SELECT record_id, min(price) AS lo, max(price) AS hi FROM observation GROUP BY 1) WHERE lo IS NOT NULL")
def q_price_label(spark: SparkSession, d: str) -> DataFrame:
    g = _log(spark, d).groupBy("record_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi")).filter("lo is not null")
    return g.select("record_id", V.price_label(F.col("lo"), F.col("hi")).alias("label"))


@query("SELECT archive_id, e.date, e.kind, e.price FROM (SELECT archive_id, unnest(timeline) AS e FROM archive_row)")
def q_archive_events(spark: SparkSession, d: str) -> DataFrame:
    """Stored timelines as rows."""
    return table(spark, d, "archive_row").select("archive_id", F.explode("timeline").alias("e")).select("archive_id", "e.date", "e.kind", "e.price")


@query("SELECT DISTINCT source, url FROM (SELECT source, url FROM listing UNION ALL SELECT source, url FROM archive_row UNION ALL SELECT source, url FROM observation) WHERE url IS NOT NULL")
def q_active_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses known to any table."""
    parts = [table(spark, d, t).select("source", "url") for t in ("listing", "archive_row", "observation")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("url is not null").distinct()


@query("SELECT source, type, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY source, type, url ORDER BY seq) k FROM listing WHERE url IS NOT NULL) WHERE k = 1")
def q_scan_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each address in a scan: a minimum over structs, pre-aggregated."""
    rows = table(spark, d, "listing").filter("url is not null").select("source", "type", "url", "seq")
    return rows.groupBy("source", "type", "url").agg(F.min("seq").alias("seq"))


@query("SELECT user_id, date_trunc('day', ts)::DATE AS day, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def q_stream_observe(spark: SparkSession, d: str) -> DataFrame:
    """One event of a type per user and day, by the streaming job run over the files as they are."""
    from plotwright.streaming.observe import run_available

    return run_available(spark, f"{d}/events.parquet")


# Page sources: pages are made of listing rows and read back


def _pages(rows: DataFrame, html) -> DataFrame:
    return rows.select(html.alias("html"), "type", F.lit(None).cast("string").alias("town"))


@query("""SELECT CASE WHEN regexp_matches(url, '/\\d+\\.html') THEN regexp_extract(url, '/(\\d+)\\.html', 1) ELSE url END AS source_id, url, nullif(title, '') AS title, price, area, rooms, nullif(locality, '') AS locality, nullif(street, '') AS street, archived IS TRUE AS archived, image
    FROM listing WHERE url NOT LIKE '%na-wynajem%' OR url IS NULL""")
def q_read_json_ld(spark: SparkSession, d: str) -> DataFrame:
    """Listing rows written as JSON-LD pages with Polish numbers and read by the page source."""
    rows = table(spark, d, "listing")
    item = F.struct(F.struct(F.col("street").alias("streetAddress"), F.col("locality").alias("addressLocality")).alias("address"), F.struct(F.replace(F.col("area").cast("string"), F.lit("."), F.lit(",")).alias("value")).alias("floorSize"), F.col("rooms").alias("numberOfRooms"))
    offer = F.struct(F.when(F.col("archived"), "https://schema.org/SoldOut").otherwise("https://schema.org/InStock").alias("availability"), F.col("price").cast("string").alias("price"), "url", F.col("title").alias("name"), "image", item.alias("itemOffered"))
    page = F.to_json(F.struct(F.lit("CollectionPage").alias("@type"), F.struct(F.array(F.struct(F.array(offer).alias("offers"))).alias("offers")).alias("mainEntity")))
    got = P.nieruchomosci_online(_pages(rows, F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), page, F.lit("</script></html>"))))
    return got.select("source_id", "url", "title", "price", "area", "rooms", "locality", "street", "archived", "image")


@query("SELECT source_id, url, title, price, area, rooms, CASE WHEN type = 'house' THEN plot_area END AS plot_area, floor, locality, district, NOT coalesce(is_private, true) AS business FROM (SELECT * REPLACE (seq::VARCHAR AS source_id) FROM listing) WHERE price <> 0")
def q_read_state(spark: SparkSession, d: str) -> DataFrame:
    """Listing rows written as doubly encoded page states and read by the page source."""
    rows = table(spark, d, "listing")
    param = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit("shown").alias("value"), v.cast("string").alias("normalizedValue"))
    params = F.filter(F.array(param("m", F.col("area")), param("rooms", F.col("rooms")), param("area", F.col("plot_area")), param("floor_select", F.col("floor"))), lambda p: p["normalizedValue"].isNotNull())
    ad = F.struct(F.col("seq").alias("id"), "url", "title", F.struct(F.struct(F.col("price").alias("value")).alias("regularPrice")).alias("price"), params.alias("params"), F.struct(F.col("locality").alias("cityName"), F.col("district").alias("districtName")).alias("location"), (~F.coalesce("is_private", F.lit(True))).alias("isBusiness"))
    state = F.to_json(F.struct(F.struct(F.struct(F.array(ad).alias("ads")).alias("listing")).alias("listing")))
    quoted = F.replace(F.replace(state, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    got = P.olx(_pages(rows, F.concat(F.lit('<script>window.__PRERENDERED_STATE__= "'), quoted, F.lit('";</script>'))))
    return got.select("source_id", "url", "title", "price", "area", "rooms", "plot_area", "floor", "locality", "district", (~F.col("is_private")).alias("business"))


@query("""SELECT source_id, title, price, area, rooms, locality, nullif(street, '') AS street, is_private, market, image FROM (SELECT * REPLACE (seq::VARCHAR AS source_id, lower(nullif(market, '')) AS market) FROM listing) WHERE type IN ('flat', 'house')""")
def q_read_script(spark: SparkSession, d: str) -> DataFrame:
    """Listing rows written as script pages and read by the page source."""
    rows = table(spark, d, "listing")
    words = F.create_map(*[F.lit(x) for i, w in enumerate(N.NUMERALS, 1) for x in (i, w.upper())])
    named = lambda c: F.struct(F.nullif(F.col(c), F.lit("")).alias("name"))
    ad = F.struct(
        F.col("seq").alias("id"), F.when(F.col("type") == "flat", "FLAT").when(F.col("type") == "house", "HOUSE").otherwise("INVESTMENT").alias("estate"), "title", F.upper("market").alias("market"), F.struct(F.col("price").alias("value")).alias("totalPrice"),
        F.col("area").alias("areaInSquareMeters"), F.try_element_at(words, F.col("rooms")).alias("roomsNumber"), F.struct(F.struct(F.struct(F.col("locality").alias("name")).alias("city"), named("street").alias("street")).alias("address")).alias("location"),
        F.col("is_private").alias("isPrivateOwner"), F.array(F.struct(F.col("image").alias("large"))).alias("images"),
    )
    page = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.array(ad).alias("items")).alias("searchAds")).alias("data")).alias("pageProps")).alias("props")))
    got = P.otodom(_pages(rows, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), page, F.lit("</script>"))))
    return got.select("source_id", "title", "price", "area", "rooms", "locality", "street", "is_private", "market", "image")


@query("""SELECT seq::VARCHAR AS source_id, 'https://gratka.pl/ob/' || seq AS url, price, area, rooms, 'Miasto' AS locality, nullif(district, '') AS district, '2024-05-06' AS created, CASE WHEN image LIKE 'http%' AND image NOT LIKE '%.svg' AND image NOT LIKE '%nuxt-assets%' THEN image END AS image FROM listing""")
def q_read_cards(spark: SparkSession, d: str) -> DataFrame:
    """Listing rows written as pages of marked cards and read by the Arrow-batched parser."""
    rows = table(spark, d, "listing")
    mark = lambda m, c: F.concat(F.lit(f'<p data-cy="{m}">'), F.coalesce(c, F.lit("")), F.lit("</p>"))
    price = F.concat(F.replace(F.format_number("price", 0), F.lit(","), F.lit(" ")), F.lit(" zł"))
    place = F.concat_ws(", ", F.nullif("district", F.lit("")), F.lit("Miasto"), F.lit("śląskie"))
    card = F.concat(
        F.lit('<div data-cy="card"><a data-cy="propertyUrl" href="/ob/'), F.col("seq"), F.lit('">x</a>'), F.coalesce(F.concat(F.lit('<img src="'), "image", F.lit('">')), F.lit("")), mark("propertyCardLocation", place), mark("propertyCardPrice", price),
        mark("cardPropertyInfoArea", F.concat(F.replace(F.col("area").cast("string"), F.lit("."), F.lit(",")), F.lit(" m²"))), mark("cardPropertyInfoRooms", F.concat(F.col("rooms"), F.lit(" pok."))), mark("descriptionAddedAtDate", F.lit("dodane 2024.05.06")), F.lit("</div>"),
    )
    got = P.gratka(_pages(rows, F.concat(F.lit("<html><body>"), card, F.lit("</body></html>"))))
    return got.select("source_id", "url", "price", "area", "rooms", "locality", "district", "created", "image")


@query("SELECT kind, d, c, a, izb, nullif(left(rynek, 1), '') AS rynek, nullif(trim(msc), '') AS msc, nullif(trim(ul), '') AS ul, nullif(trim(nr), '') AS nr, nullif(trim(dz), '') AS dz FROM (SELECT DISTINCT kind, d, c, a, izb, rynek, msc, ul, nr, dz FROM deed WHERE kind = 'flat' AND c <> 0 AND a <> 0 AND d IS NOT NULL)")
def q_read_register(spark: SparkSession, d: str) -> DataFrame:
    """Deeds of flats written as register pages and read back as typed deeds."""
    from plotwright.sources.tables import register_features

    rows = table(spark, d, "deed").filter("kind = 'flat'")
    tag = lambda n, c: F.coalesce(F.concat(F.lit(f"<ms:{n}>"), F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</ms:{n}>")), F.lit(f"<ms:{n}/>"))
    address = F.concat(F.lit("MSC:"), F.coalesce("msc", F.lit("")), F.lit(";UL:"), F.coalesce("ul", F.lit("")), F.lit(";NR_PORZ:"), F.coalesce("nr", F.lit("")))
    xml = F.concat(
        F.lit('<c><m><ms:lokale gml:id="1"><ms:msGeometry><gml:pos>1 2</gml:pos></ms:msGeometry>'), tag("dok_data", F.concat(F.col("d").cast("string"), F.lit("T00:00:00+01:00"))), tag("tran_rodzaj_trans", F.lit("wolnyRynek")), tag("tran_rodzaj_rynku", F.col("rynek")),
        tag("lok_cena_brutto", F.col("c")), tag("lok_pow_uzyt", F.col("a")), tag("lok_liczba_izb", F.col("izb")), tag("lok_adres", address), tag("lok_funkcja", F.lit("mieszkalna")), tag("lok_id_lokalu", F.concat("dz", F.lit("_BUD.1"))), F.lit("</ms:lokale></m></c>"),
    )
    return D.clean_deeds(register_features(rows.select(xml.alias("xml")), "flat"), "flat").select("kind", "d", "c", "a", "izb", "rynek", "msc", "ul", "nr", "dz").distinct()


# State


def _records(log: DataFrame) -> DataFrame:
    """Records with nothing but what their log tells."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kinds = {"rooms": "int", "plot_area": "double", "price": "bigint"}
    snapshot = [none(c, kinds.get(c, "string")) for c in S.SNAPSHOT]
    return H.seen_span(log).select("record_id", F.col("record_id").alias("record_ord"), none("type", "string"), none("area", "double"), none("hashes", "array<array<bigint>>"), none("photo_urls", "array<string>"), "first_seen", "last_seen", none("delisted", "date"), F.lit(False).alias("development"), *snapshot)


@query("""WITH o AS (SELECT doc_id AS record_id, fetched_at::DATE AS date, md5(text) AS url FROM documents), h AS (SELECT url, first(record_id ORDER BY date NULLS LAST, record_id) AS kept FROM o GROUP BY 1)
    SELECT kept AS record_id, min(date) AS first_seen, count(DISTINCT coalesce(date, DATE '1900-01-01')) AS sightings FROM o JOIN h USING (url) GROUP BY 1""")
def q_compact(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records that are seen under the digest of their text: those of one text merged into the oldest."""
    log = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.lit(1).cast("bigint").alias("obs_seq"), F.col("fetched_at").cast("date").alias("date"), F.lit(None).cast("bigint").alias("price"), F.md5("text").alias("url"), "source", F.lit(None).cast("string").alias("status"))
    records, log = S.compact(_records(log), log)
    return records.select("record_id", "first_seen").join(log.groupBy("record_id").agg(F.count(F.lit(1)).alias("sightings")), "record_id")


@query("""WITH o AS (SELECT user_id, ts::DATE AS date, event_id, event_type, CAST(floor(value / 10) AS BIGINT) AS price FROM events), t AS (SELECT max(date) AS today FROM o), l AS (SELECT user_id, first(event_type ORDER BY date DESC, event_id DESC) AS latest FROM o GROUP BY 1)
    SELECT user_id, true AS relisted, arg_max(price, event_id) FILTER (WHERE price > 0) AS prev_price FROM o JOIN l USING (user_id), t WHERE date < today AND event_type <> latest GROUP BY 1""")
def q_relisted(spark: SparkSession, d: str) -> DataFrame:
    """Users seen on an earlier day with another event than their latest, and the last price then."""
    log = table(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("obs_seq"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("url"), F.floor(F.col("value") / 10).alias("price"))
    today = log.agg(F.max("date")).first()[0]
    return H.relisted_before(log, F.lit(today)).withColumnRenamed("record_id", "user_id")


@query("""WITH t AS (SELECT max(date) AS today FROM observation), g AS (SELECT DISTINCT url FROM observation WHERE status = 'archived' AND url IS NOT NULL), l AS (SELECT record_id, max(date) AS last_date, first(url ORDER BY date DESC, obs_seq, url) AS last_url FROM observation WHERE date IS NOT NULL GROUP BY 1)
    SELECT l.record_id, last_date AS delisted FROM l JOIN g ON g.url = l.last_url, t WHERE last_date < today - 7""")
def q_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Stale records whose last address is known to be gone get the day they were last seen."""
    log = _log(spark, d)
    today = log.agg(F.max("date")).first()[0]
    one = log.groupBy("record_id", "date", "obs_seq").agg(F.min(F.struct(F.col("url").isNull().alias("n"), "url", "source", "price", "status")).alias("r")).select("record_id", "date", "obs_seq", "r.url", "r.source", "r.price", "r.status")
    gone = log.filter("status = 'archived' and url is not null").select("url", F.lit(True).alias("gone")).distinct()
    none = spark.createDataFrame([], "url string")
    return S.sweep(_records(log), one, none, gone, F.lit(today)).filter("delisted is not null").select("record_id", "delisted")
