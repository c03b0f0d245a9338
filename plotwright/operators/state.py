"""State transitions as functions: new state = f(state, batch, today). Nothing is changed in place and no clock is read.

``records``: record_id, record_ord, type, area, hashes, photo_urls, first_seen, last_seen, delisted, development and the
snapshot fields. ``log``: the sightings (``sources.schemas.OBSERVATION``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.config import LIMITS
from plotwright.functions.addresses import numbers_agree, plain
from plotwright.functions.numbers import area_bucket
from plotwright.operators.components import connected_components
from plotwright.operators.history import append_observations, first_sightings, last_sighting, match_by_photo, match_cards, ordered_union, url_index
from plotwright.operators.photo_join import photo_links
from plotwright.session import materialize

SNAPSHOT = ("title", "image", "locality", "district", "street", "rooms", "floor", "plot_area", "url", "source", "price")
OVERRIDABLE = ("street", "nr", "locality", "rooms", "floor", "plot_area", "area", "dzialka_id", "x", "y")


def _present(c: str) -> Column:
    return F.when(F.col(c).cast("string") != "", F.col(c))


def group_new_cards(cards: DataFrame, threshold: int = LIMITS.photo_bits) -> DataFrame:
    """``seq, head``: cards without a record that belong to one new record, by address or by a photo within one square metre."""
    urls = cards.filter("url is not null").select("url", "seq")
    by_url = urls.join(urls.groupBy("url").agg(F.min("seq").alias("head")), "url").filter("seq != head").select(F.col("head").alias("a"), F.col("seq").alias("b"))
    use = cards.filter(~F.coalesce("development", F.lit(False)) & F.col("type").isNotNull()).select("seq", "type", "phashes", area_bucket(F.col("area")).alias("bucket")).filter("bucket is not null")
    # A pair at most one bucket apart meets once in the bucket of both or, as (lower, upper), in the lower one.
    block = lambda d: F.concat_ws("/", "type", (F.col("bucket") + d).cast("string")).alias("block")
    held = use.select(F.col("seq").alias("id"), block(0), F.col("phashes").alias("hashes"))
    upper = use.select(F.col("seq").alias("id"), block(-1), F.col("phashes").alias("hashes"))
    by_photo = photo_links(held, None, threshold).unionByName(photo_links(held, upper, threshold))
    groups = connected_components(by_url.unionByName(by_photo)).select(F.col("v").alias("seq"), F.col("comp").alias("head"))
    return cards.select("seq").join(groups, "seq", "left").select("seq", F.coalesce("head", "seq").alias("head"))


def update(records: DataFrame, log: DataFrame, cards: DataFrame, today: Column, limits=LIMITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, log, ``seq, record_id``) after a day's cards: matched or created, observed, snapshots refreshed, ``delisted`` cleared."""
    found = materialize(match_cards(cards, records, log, limits.photo_bits), "matched")
    unknown = cards.join(found.filter("record_id is null").select("seq"), "seq")
    last = records.agg(F.coalesce(F.max("record_id"), F.lit(0)).alias("m"), F.coalesce(F.max("record_ord"), F.lit(0)).alias("o")).first()
    fresh = materialize(group_new_cards(unknown, limits.photo_bits).withColumn("record_id", F.lit(last["m"]) + F.col("head") + 1), "fresh")
    ids = materialize(found.filter("record_id is not null").select("seq", "record_id").unionByName(fresh.select("seq", "record_id")), "ids")
    seen = cards.join(ids, "seq")
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).cast("string") != "", F.col("seq"))).alias(f"n_{c}")
    arrays = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda s: F.coalesce(s[c], F.array()))).alias(f"n_{c}")
    news = seen.groupBy("record_id").agg(*[latest(c) for c in SNAPSHOT], F.max_by("type", -F.col("seq")).alias("n_type"), F.max_by("area", -F.col("seq")).alias("n_area"), arrays("phashes"), arrays("photo_urls"), F.bool_or(F.coalesce("development", F.lit(False))).alias("n_dev"))
    old = records.join(news, "record_id", "full")
    matched, new = F.col("n_dev").isNotNull(), F.col("record_ord").isNull()
    out = old.select(
        "record_id", F.coalesce("record_ord", F.lit(last["o"]) + F.col("record_id") - last["m"]).alias("record_ord"), F.coalesce("type", "n_type").alias("type"), F.when(new, F.col("n_area")).otherwise(F.col("area")).alias("area"),
        ordered_union(F.col("hashes"), F.col("n_phashes"), limits.stored_hashes).alias("hashes"), ordered_union(F.col("photo_urls"), F.col("n_photo_urls"), limits.stored_urls).alias("photo_urls"),
        F.when(new, today).otherwise(F.col("first_seen")).alias("first_seen"), F.when(matched, today).otherwise(F.col("last_seen")).alias("last_seen"), F.when(~matched, F.col("delisted")).alias("delisted"),
        (F.coalesce("development", F.lit(False)) | F.coalesce("n_dev", F.lit(False))).alias("development"), *[F.coalesce(_present(f"n_{c}"), F.col(c)).alias(c) for c in SNAPSHOT],
    )
    sightings = seen.select("record_id", F.col("seq").alias("obs_seq"), today.alias("date"), "price", "url", "source", F.lit(None).cast("string").alias("status"))
    return out, append_observations(log, sightings), ids


def observe_archived(records: DataFrame, log: DataFrame, archived: DataFrame, today: Column, threshold: int = LIMITS.photo_bits) -> tuple[DataFrame, DataFrame]:
    """(records, log) after a portal says advertisements are closed: found by address, else by photo; delisted today unless seen live today."""
    known = url_index(log).select(F.col("url").alias("k"), F.col("record_id").alias("by_url"))
    by_photo = match_by_photo(archived, records, threshold).select("seq", F.col("record_id").alias("by_photo"))
    hit = archived.join(known, F.col("url") == F.col("k"), "left").join(by_photo, "seq", "left").withColumn("record_id", F.coalesce("by_url", "by_photo")).filter("record_id is not null")
    live = log.filter((F.col("date") == today) & (F.coalesce("status", F.lit("")) != "archived")).select("record_id").distinct()
    gone = hit.select("record_id").distinct().join(live, "record_id", "left_anti").withColumn("gone", F.lit(True))
    news = hit.select("record_id", F.col("seq").alias("obs_seq"), today.alias("date"), "price", "url", "source", F.lit("archived").alias("status"))
    out = records.join(gone, "record_id", "left").withColumn("delisted", F.when(F.col("gone"), today).otherwise(F.col("delisted"))).drop("gone")
    return out, append_observations(log, news)


def sweep(records: DataFrame, log: DataFrame, active: DataFrame, fetched: DataFrame, today: Column, grace: int = LIMITS.grace_days) -> DataFrame:
    """``records`` after a staleness sweep: resurfaced ones lose ``delisted``; stale ones whose page is gone (``fetched``: url, gone) get the day last seen."""
    last = last_sighting(log).select("record_id", F.col("date").alias("l_date"), F.col("url").alias("l_url"))
    alive = log.join(active.select("url").distinct(), "url", "left_semi").select("record_id").distinct().withColumn("alive", F.lit(True))
    dead = fetched.filter("gone").select(F.col("url").alias("g_url")).distinct().withColumn("dead", F.lit(True))
    r = records.join(last, "record_id", "left").join(alive, "record_id", "left").join(dead, F.col("l_url") == F.col("g_url"), "left")
    back = F.coalesce("alive", F.lit(False)) | F.coalesce(F.col("l_date") >= F.date_sub(today, grace), F.lit(False))
    ends = F.col("delisted").isNull() & ~F.coalesce("development", F.lit(False)) & F.coalesce("dead", F.lit(False))
    return r.withColumn("delisted", F.when(back, F.lit(None).cast("date")).when(ends, F.col("l_date")).otherwise(F.col("delisted"))).select(*records.columns)


def compact(records: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, log) with records that share an address merged into the one with photos, else the oldest.

    An address whose records include several with photos links nothing; a chain that would bring several such
    records together through other addresses is left as it is.
    """
    shown = records.select("record_id", (F.coalesce(F.size("hashes"), F.lit(0)) > 0).alias("hashed"), "first_seen", "record_ord")
    seen = log.filter("url is not null").select("url", "record_id").distinct().join(shown, "record_id")
    safe = seen.groupBy("url").agg(F.count_if("hashed").alias("h"), F.min("record_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("h <= 1 and n > 1")
    edges = seen.join(safe, "url").filter("record_id != head").select(F.col("head").alias("a"), F.col("record_id").alias("b"))
    comps = connected_components(edges).select(F.col("v").alias("record_id"), "comp")
    members = comps.join(shown, "record_id")
    order = F.struct((~F.col("hashed")).alias("p"), F.col("first_seen").isNull().alias("n"), "first_seen", "record_ord", "record_id")
    keep = members.groupBy("comp").agg(F.min(order).alias("k"), F.count_if("hashed").alias("h")).filter("h <= 1").select("comp", F.col("k.record_id").alias("kept"))
    into = materialize(comps.join(keep, "comp").select("record_id", "kept"), "into")
    moved = log.join(into, "record_id", "left").withColumn("record_id", F.coalesce("kept", "record_id")).withColumn("__own", F.col("kept").isNull() | (F.col("kept") == F.col("record_id"))).drop("kept", "__own")
    merged_log = first_sightings(moved, ["record_id", "date", "url"], ["obs_seq", "price"])
    grouped = records.join(into, "record_id", "left").withColumn("kept", F.coalesce("kept", "record_id"))
    own = F.when(F.col("record_id") == F.col("kept"), 0).otherwise(1)
    extra = grouped.groupBy("kept").agg(
        F.min("first_seen").alias("m_first"), F.max("last_seen").alias("m_last"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(own.alias("o"), "record_ord", "photo_urls"))), lambda s: F.coalesce(s["photo_urls"], F.array().cast("array<string>"))))).alias("m_urls"),
        *[F.min_by(F.col(c), F.when(F.col(c).cast("string") != "", F.struct(own.alias("o"), "record_ord"))).alias(f"m_{c}") for c in SNAPSHOT],
    )
    out = records.join(extra, F.col("record_id") == F.col("kept")).withColumns({"first_seen": F.col("m_first"), "last_seen": F.col("m_last"), "photo_urls": F.col("m_urls"), **{c: F.col(f"m_{c}") for c in SNAPSHOT}})
    return out.select(*records.columns), merged_log


def apply_overrides(records: DataFrame, log: DataFrame, overrides: DataFrame) -> DataFrame:
    """``records`` with pinned values by address: known fields only, nulls change nothing, unknown addresses are ignored.

    Of several pins of one record the last counts, field by field: by ``pin_seq`` where ``overrides`` has it, else by address.
    """
    fields = [c for c in OVERRIDABLE if c in overrides.columns]
    order = F.struct("pin_seq", "url") if "pin_seq" in overrides.columns else F.col("url")
    hit = overrides.withColumn("__o", order).join(url_index(log), "url").groupBy("record_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__o"))).alias(f"o_{c}") for c in fields]).withColumn("manual", F.lit(True))
    base = records.drop("manual")
    return base.join(hit, "record_id", "left").select(*[F.coalesce(f"o_{c}", c).cast(dict(records.dtypes)[c]).alias(c) if c in fields else F.col(c) for c in base.columns], *[F.col(f"o_{c}").alias(c) for c in fields if c not in base.columns], F.coalesce("manual", F.lit(False)).alias("manual"))


def attach_hashes(listings: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings with ``phashes`` and ``photo_urls`` from the cache, addresses to be hashed): an entry without hashes is a miss."""
    held = cache.filter(F.coalesce(F.size("hashes"), F.lit(0)) > 0).select(F.col("url").alias("c_url"), F.col("hashes").alias("c_hashes"), F.col("urls").alias("c_urls"))
    joined = listings.drop("phashes", "photo_urls").join(held, F.col("url") == F.col("c_url"), "left")
    out = joined.withColumnRenamed("c_hashes", "phashes").withColumnRenamed("c_urls", "photo_urls")
    return out.drop("c_url"), joined.filter("url is not null and c_url is null").select("source", "url").distinct()


def keep_sales(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sales of records: those found now, else those known before; a run without a match clears nothing."""
    return new.unionByName(old.join(new.select("record_id").distinct(), "record_id", "left_anti"), allowMissingColumns=True)


def enrich(cards: DataFrame, ids: DataFrame, *by_record: DataFrame) -> DataFrame:
    """Cards joined once, at the end, with what is known of their records (timelines, sales, trails)."""
    out = cards.join(ids, "seq", "left")
    for extra in by_record:
        out = out.join(extra, "record_id", "left")
    return out


def locate(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with x and y of a local address table, where town, street and number agree; the number must be confirmed."""
    p = places.select(plain(F.col("town")).alias("p_town"), plain(F.col("street")).alias("p_street"), F.col("number").alias("p_number"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    keyed = rows.withColumns({"k_town": plain(F.col("locality")), "k_street": plain(F.col("street"))})
    met = keyed.join(p, (F.col("k_town") == F.col("p_town")) & (F.col("k_street") == F.col("p_street")) & numbers_agree(F.col("nr"), F.col("p_number")), "left")
    return met.withColumnsRenamed({"p_x": "x", "p_y": "y"}).drop("k_town", "k_street", "p_town", "p_street", "p_number")


def parcels_at(points: DataFrame, parcels: DataFrame, cell: float) -> DataFrame:
    """``points`` (``x, y``) with ``parcel_id`` of the smallest-named parcel (``parcel_id, x0, y0, x1, y1``, edges included) they lie in, or null.

    Both go to the cells of a grid of width ``cell``, about the size of a parcel, so the lookup is an equi-join.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(float(cell)))
    whole = parcels.filter("x0 <= x1 and y0 <= y1")
    held = whole.withColumn("__px", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("__py", F.explode(F.sequence(at("y0"), at("y1")))).select("parcel_id", "x0", "y0", "x1", "y1", "__px", "__py")
    asked = points.drop("parcel_id").withColumn("__point", F.monotonically_increasing_id())
    asked = materialize(asked, "points")  # numbered once
    met = asked.select("__point", "x", "y", at("x").alias("__cx"), at("y").alias("__cy")).join(held, (F.col("__cx") == F.col("__px")) & (F.col("__cy") == F.col("__py")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return asked.join(met.groupBy("__point").agg(F.min("parcel_id").alias("parcel_id")), "__point", "left").drop("__point")
