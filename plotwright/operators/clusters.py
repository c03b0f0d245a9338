"""Advertisements of one property brought together: size blocks, photo components, price spread, cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.config import LIMITS, SOURCE_RANK, UNRANKED
from plotwright.functions.numbers import area_key
from plotwright.functions.photos import LIMBS
from plotwright.functions.text import strip
from plotwright.operators.photo_join import photo_groups, photo_links
from plotwright.session import materialize

# Fixed value: how developers' advertisements read.
DEVELOPER_TITLE = r"(?i)deweloper|inwestycj|rynek\s+pierwotn|nowe\s+osiedle|stan\s+deweloperski|etap\s+[ivx0-9]"
DEVELOPER_MARKET = ("primary", "pierwotn")
DISPLAY = ("title", "type", "area", "rooms", "plot_area", "floor", "locality", "district", "street", "image", "is_private", "agency", "market")


def is_developer(market: Column, title: Column) -> Column:
    """New-build by the portal's word or by the title."""
    said = reduce(Column.__or__, [F.startswith(F.coalesce(market, F.lit("")), F.lit(p)) for p in DEVELOPER_MARKET])
    return said | F.coalesce(title, F.lit("")).rlike(DEVELOPER_TITLE)


def missing(c: str) -> Column:
    """A display field counts as missing when null or the empty text; zero and false are present."""
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def source_rank(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(known, source), F.lit(UNRANKED))


def offer_rank() -> Column:
    """Orders the rows that can stand for a property: with picture, trusted source, cheap, early."""
    return F.struct(F.when(missing("image"), 1).otherwise(0).alias("no_image"), source_rank(F.col("source")).alias("source_rank"), F.coalesce(F.col("price").cast("double"), F.lit(float("inf"))).alias("price_rank"), F.col("seq").alias("seq_rank"))


def size_key() -> list[Column]:
    """Columns that are equal for advertisements of one size; houses ignore rooms, rows without area stand alone."""
    return [F.col("type").alias("k_type"), area_key(F.col("area")).alias("k_area"), F.when(F.col("type") != "house", F.col("rooms")).alias("k_rooms"), F.when(F.col("area").isNull(), F.col("seq")).alias("k_alone")]


KEY = ["k_type", "k_area", "k_rooms", "k_alone"]


def has_hashes(c: str = "phashes") -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _galleries(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(galleries, members): ``id, block, hashes`` of the different galleries of each block of rows equal in ``keys`` (null equals null), and ``id, seq`` of the rows that have them.

    Repeated scans show the same pictures; equal galleries are compared once.
    """
    # Unambiguous: a slash in a value is followed by an s, one for null by a dash, one between values by a comma.
    block = F.concat_ws("/,", *[F.coalesce(F.replace(F.col(k).cast("string"), F.lit("/"), F.lit("/s")), F.lit("/-")) for k in keys])
    shown = rows.filter(has_hashes()).select("seq", "phashes", block.alias("block"))
    keyed = materialize(shown.withColumn("k", F.struct(F.xxhash64("block", "phashes").alias("h"), F.xxhash64("phashes", "block").alias("g"))), "galleries")
    reps = keyed.groupBy("k").agg(F.min("seq").alias("id"))
    members = materialize(keyed.select("k", "seq").join(reps, "k").select("id", "seq"), "members")
    return keyed.join(members.filter("id = seq").select("seq"), "seq", "left_semi").select(F.col("seq").alias("id"), "block", F.col("phashes").alias("hashes")), members


def photo_pairs(rows: DataFrame, keys: list[str], threshold: int = LIMITS.photo_bits) -> DataFrame:
    """``a, b`` (a < b): rows equal in ``keys`` (null equals null) with a photo in common, out of the links of :func:`photo_links`."""
    galleries, members = _galleries(rows, keys)
    links = photo_links(galleries, None, threshold)
    named = lambda c: members.select(F.col("id").alias(f"id_{c}"), F.col("seq").alias(c))
    across = links.toDF("id_a", "id_b").join(named("a"), "id_a").join(named("b"), "id_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # A gallery meets itself if it has a photo at all: any that is whole.
    whole = galleries.filter(F.exists("hashes", lambda h: (F.size(h) == LIMBS) & F.forall(h, lambda x: x.isNotNull()))).select(F.col("id").alias("id_a"))
    same = named("a").join(whole, "id_a", "left_semi").join(named("b").withColumnRenamed("id_b", "id_a"), "id_a").filter("a < b").select("a", "b")
    return across.unionByName(same)


def photo_components(rows: DataFrame, keys: list[str], threshold: int = LIMITS.photo_bits) -> DataFrame:
    """``v, comp``: every row equal in ``keys`` to, and linked by photos with, another row, with the smallest seq of its group. No pairs are written."""
    galleries, members = _galleries(rows, keys)
    groups = photo_groups(galleries, threshold)
    several = members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("several"))
    placed = members.join(groups.withColumnRenamed("v", "id"), "id", "left").join(several, "id", "left")
    return placed.filter("comp is not null or several").select(F.col("seq").alias("v"), F.coalesce("comp", "id").alias("comp"))


def unify_sizes(rows: DataFrame) -> DataFrame:
    """Rows of one town and price that share photos but differ in size take the size of the best-ranked of them."""
    keyed = rows.withColumn("u_town", F.lower(strip(F.col("locality"))))
    use = keyed.filter(has_hashes() & ~is_developer(F.col("market"), F.col("title")) & (F.col("u_town") != "") & (F.coalesce("price", F.lit(0)) != 0))
    groups = photo_components(use, ["type", "u_town", "price"])
    members = keyed.join(groups.withColumnRenamed("v", "seq"), "seq")
    best = members.groupBy("comp").agg(F.min_by(F.struct("area", "rooms"), offer_rank()).alias("best"), F.countDistinct(area_key(F.col("area"))).alias("sizes"))
    chosen = groups.join(best.filter("sizes > 1"), "comp").select(F.col("v").alias("seq"), "best")
    new_rooms = F.when(F.col("best").isNotNull() & (F.col("type") == "flat"), F.col("best.rooms")).otherwise(F.col("rooms"))
    return rows.join(chosen, "seq", "left").withColumns({"area": F.when(F.col("best").isNotNull(), F.col("best.area")).otherwise(F.col("area")), "rooms": new_rooms}).select(*rows.columns)


def spread_starts(prices: Column, spread: float) -> Column:
    """First prices of the clusters of an ascending array of distinct prices: a price more than ``spread`` times its cluster's first opens a new cluster."""
    empty = F.array().cast("array<double>")
    return F.aggregate(prices, empty, lambda acc, p: F.when((F.size(acc) == 0) | (p > F.try_element_at(acc, F.lit(-1)) * F.lit(float(spread))), F.concat(acc, F.array(p))).otherwise(acc))


def split_by_price(rows: DataFrame, keys: list[str], price: str = "price", spread: float = LIMITS.price_spread) -> DataFrame:
    """``rows`` with ``part``: number of the price cluster in its block; rows without price join the first.

    Only a block's distinct prices meet in one place; the rows are joined to the few cluster starts.
    """
    p = F.col(price).cast("double")
    starts = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(p)).alias("__prices")).select(*[F.col(k).alias(f"s_{k}") for k in keys], spread_starts(F.col("__prices"), spread).alias("__starts"))
    equal = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys])
    below = F.size(F.filter("__starts", lambda s: s <= F.col("__p")))
    return rows.withColumn("__p", p).join(starts, equal).withColumn("part", F.when(F.col("__p").isNull(), 0).otherwise(F.greatest(below - 1, F.lit(0)))).drop("__p", "__starts", *[f"s_{k}" for k in keys])


def developer_flags(rows: DataFrame, keys: list[str], ads: int = LIMITS.developer_ads) -> DataFrame:
    """``keys, developer``: groups with a developer's advertisement or with ``ads`` advertisements of one source."""
    by_source = rows.groupBy(*keys, "source").agg(F.countDistinct(F.struct("source_id")).alias("n"), F.bool_or(is_developer(F.col("market"), F.col("title"))).alias("d"))
    return by_source.groupBy(*keys).agg((F.bool_or("d") | (F.max("n") >= ads)).alias("developer"))


def assign_clusters(rows: DataFrame, limits=LIMITS) -> DataFrame:
    """``rows`` with ``cluster`` (a text) and ``developer``.

    In a size block where any row has photo hashes, clusters are photo components and rows without
    hashes stand alone; else they are price clusters. Developers' clusters are cut by price.
    """
    keyed = rows.select("*", *size_key())
    seen = keyed.groupBy(*KEY).agg(F.max(has_hashes().cast("int")).alias("hashed"))
    equal = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in KEY])
    keyed = keyed.join(seen.select(*[F.col(k).alias(f"h_{k}") for k in KEY], "hashed"), equal).drop(*[f"h_{k}" for k in KEY])
    photo = keyed.filter("hashed = 1")
    comps = photo_components(photo, KEY, limits.photo_bits).withColumnRenamed("v", "seq")
    photo = photo.join(comps, "seq", "left").withColumn("base", F.concat(F.lit("p"), F.coalesce("comp", "seq"))).drop("comp")
    flags = developer_flags(photo, ["base"], limits.developer_ads)
    photo = photo.join(flags, "base").drop("hashed")
    plain = split_by_price(keyed.filter("hashed = 0"), KEY, "price", limits.price_spread)
    block_flags = developer_flags(plain, KEY, limits.developer_ads).select(*[F.col(k).alias(f"f_{k}") for k in KEY], "developer")
    flagged = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in KEY])
    block = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in KEY])
    plain = plain.join(block_flags, flagged).drop(*[f"f_{k}" for k in KEY])
    plain = plain.withColumn("base", F.when(F.col("developer"), F.concat(F.lit("b"), block)).otherwise(F.concat(F.lit("b"), block, F.lit("#"), F.col("part")))).drop("part", "hashed")
    by_price = F.concat("base", F.lit("@"), F.coalesce(F.col("price").cast("string"), F.lit("-")))
    return photo.unionByName(plain).withColumn("cluster", F.when(F.col("developer"), by_price).otherwise(F.col("base"))).drop("base", *KEY)


def build_cards(rows: DataFrame, key: str = "cluster") -> DataFrame:
    """One card per cluster: each display field of the best-ranked row that has it, the offers by address, the price range, the latest ``created``."""
    rank = offer_rank()
    first = lambda c: F.min_by(F.col(c), F.when(~missing(c), rank)).alias(c)
    heads = rows.groupBy(key).agg(
        *[first(c) for c in DISPLAY], F.min("price").alias("price"), F.max("price").alias("price_max"), F.max("created").alias("created"),
        F.min_by(F.struct("source", "url", "price_per_m2"), rank).alias("h"), F.bool_or("developer").alias("development"), F.min("seq").alias("seq"),
    )
    offer = F.struct("source", "url", "price", "price_per_m2", "created", "is_private", "agency")
    one_per_url = rows.groupBy(key, F.coalesce("url", F.lit("")).alias("__u")).agg(F.min(F.struct(rank.alias("r"), offer.alias("o"))).alias("b"))
    order = F.struct(F.when(F.col("b.o.price").isNull(), 1).otherwise(0).alias("n"), F.col("b.o.price").alias("p"), F.col("b.r").alias("r"), F.col("b.o").alias("o"))
    offers = one_per_url.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["o"]).alias("offers"))
    ranked = rows.groupBy(key, "source").agg(F.min(source_rank(F.col("source"))).alias("r")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source"))), lambda x: x["source"]).alias("sources"))
    cheapest = F.get(F.filter("offers", lambda o: o["price"].isNotNull()), F.lit(0))
    return heads.join(offers, key).join(ranked, key).select(key, "seq", *DISPLAY, "price", "price_max", F.col("h.price_per_m2").alias("price_per_m2"), F.col("h.source").alias("source"), F.col("h.url").alias("url"), "created", "sources", "offers", cheapest.alias("cheapest"), "development")


def dedupe(rows: DataFrame, limits=LIMITS) -> DataFrame:
    """Listings to cards: sizes unified across photos, clusters assigned, cards built."""
    unified = materialize(unify_sizes(rows), "unified")  # each stage reads its input several times
    return build_cards(materialize(assign_clusters(unified, limits), "clustered"))


def link_same_size(cards: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """Cards with ``also_listed``, ``prev_price`` and ``relisted`` where two or three addresses share size and street (or town)."""
    keyed = cards.withColumns({
        "l_area": area_key(F.col("area")), "l_rooms": F.col("rooms"),
        "l_where": F.lower(strip(F.coalesce(F.nullif("street", F.lit("")), F.col("locality")))),
    })
    use = keyed.filter(~F.col("development") & F.col("l_area").isNotNull() & (F.col("l_where") != ""))
    keys = ["type", "l_area", "l_rooms", "l_where"]
    sizes = use.groupBy(*keys).agg(F.countDistinct(F.coalesce("url", F.lit(""))).alias("n"))
    small = sizes.filter(F.col("n").between(least, most)).select(*[F.col(k).alias(f"g_{k}") for k in keys])
    equal = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys])
    linked = use.join(small, equal)
    groups = linked.groupBy(*[F.col(k).alias(f"o_{k}") for k in keys]).agg(F.collect_set(F.struct("price", "url", "source")).alias("group"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys])
    others = F.array_sort(F.filter("group", lambda g: ~g["url"].eqNullSafe(F.col("url"))))
    return linked.join(groups, same).withColumn("also_listed", others).withColumn("prev_price", F.array_min(F.transform("also_listed", lambda g: g["price"]))).withColumn("relisted", F.lit(True)).select("seq", "url", "also_listed", "prev_price", "relisted")
