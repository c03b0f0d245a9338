"""Sighting logs: price trails, relists, timelines, states that follow from a log and a new batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.config import LIMITS
from plotwright.functions.numbers import area_bucket
from plotwright.functions.photos import same_photos
from plotwright.operators.photo_join import photo_links

def first_sightings(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``log`` that are the first of their ``keys`` in ``order``, then in the order of all other columns.

    A minimum over structs, pre-aggregated: a key with a third of all rows is no burden, and which row survives is defined.
    """
    rest = [c for c in order if c not in keys] + [c for c in log.columns if c not in keys and c not in order]
    return log.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}") for c in log.columns])


def last_before(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the last value that is not null of the rows before, among those equal in ``keys``, in ``order``.

    ``chunk`` must not fall as ``order`` rises. Rows are ordered chunk by chunk, so one key's rows are spread over its
    chunks; what a chunk ends with is carried to the next ones by a table of one row per chunk.
    """
    cut = rows.withColumns({"__c": F.coalesce(chunk, F.lit(-(2**40))).cast("bigint"), "__v": value})
    inside = Window.partitionBy(*keys, "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "__c").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__e"))
    ends = ends.withColumn("__p", F.last("__e", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.filter(F.col("__p").isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__c").alias("__cc"), "__p")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__c") == F.col("__cc"))
    met = cut.withColumn(out, F.last("__v", ignorenulls=True).over(inside)).join(ends, same, "left")
    return met.withColumn(out, F.coalesce(out, "__p")).select(*rows.columns, out)


def price_trail(log: DataFrame) -> DataFrame:
    """Sightings whose price differs from the one before in append order; null is a price of its own."""
    met = last_before(log, ["record_id"], ["obs_seq", "date", "url"], F.expr("obs_seq div 1024"), F.struct("price"), "__b")
    return met.filter(F.col("__b").isNull() | ~F.col("price").eqNullSafe(F.col("__b.price"))).drop("__b")


def url_price_changes(log: DataFrame) -> DataFrame:
    """Live sightings whose price differs from the last known price of the same address, by date."""
    live = log.filter(F.coalesce("status", F.lit("")) != "archived")
    met = last_before(live, ["record_id", "url"], ["date", "obs_seq", "price"], F.expr("unix_date(date) div 32"), F.col("price"), "before")
    return met.filter(F.col("price").isNotNull() & F.col("before").isNotNull() & (F.col("price") != F.col("before")))


def listings_and_relists(log: DataFrame) -> DataFrame:
    """First sighting of each address of a record: the first address is ``listed``, later ones are ``relist``."""
    first = first_sightings(log.filter(F.coalesce("status", F.lit("")) != "archived"), ["record_id", "url"], ["date", "obs_seq", "price"])
    earliest = first.groupBy(F.col("record_id").alias("__r")).agg(F.min(F.struct("date", "obs_seq", "url")).alias("__f"))
    met = first.join(earliest, F.col("record_id").eqNullSafe(F.col("__r")))
    return met.withColumn("kind", F.when(F.struct("date", "obs_seq", "url") == F.col("__f"), "listed").otherwise("relist")).drop("__r", "__f")


def last_sighting(log: DataFrame) -> DataFrame:
    """The sighting of the latest date of each record, the first appended of them."""
    best = F.struct("date", (-F.col("obs_seq")).alias("o"))
    return log.groupBy("record_id").agg(F.max_by(F.struct("date", "obs_seq", "price", "url", "source", "status"), best).alias("l")).select("record_id", "l.*")


def seen_span(log: DataFrame) -> DataFrame:
    return log.groupBy("record_id").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))


def relisted_before(log: DataFrame, today: Column) -> DataFrame:
    """``record_id, relisted, prev_price`` of records: seen before ``today`` under another address than the latest; the last price then."""
    latest = log.groupBy("record_id").agg(F.max_by("url", F.struct("date", "obs_seq")).alias("now_url"))
    earlier = log.join(latest, "record_id").filter((F.col("date") < today) & ~F.col("url").eqNullSafe(F.col("now_url")))
    return earlier.groupBy("record_id").agg(F.lit(True).alias("relisted"), F.max_by("price", F.when(F.col("price") > 0, F.col("obs_seq"))).alias("prev_price"))


def cap_timeline(events: Column, head: int = LIMITS.timeline_head, tail: int = LIMITS.timeline_tail) -> Column:
    """At most ``head`` first and ``tail`` last events of an ordered array."""
    return F.when(F.size(events) > head + tail, F.concat(F.slice(events, 1, head), F.slice(events, -tail, tail))).otherwise(events)


def timeline_events(log: DataFrame, delisted: DataFrame | None = None, sales: DataFrame | None = None) -> DataFrame:
    """``record_id, date, kind, price, source, url, build``: listings, relists, price changes, archivings, delistings and sales, one row each."""
    cols = lambda k, b: ["record_id", "date", F.lit(k).alias("kind") if isinstance(k, str) else k, "price", "source", "url", F.lit(b).cast("bigint").alias("b"), "obs_seq"]
    parts = [
        listings_and_relists(log).select(*cols(F.col("kind"), 1)),
        url_price_changes(log).select(*cols("price", 2)),
        log.filter("status = 'archived'").select(*cols("archived", 3)),
    ]
    none = lambda t: F.lit(None).cast(t)
    if delisted is not None:
        parts.append(delisted.filter("delisted is not null").select("record_id", F.col("delisted").alias("date"), F.lit("delisted").alias("kind"), none("bigint").alias("price"), none("string").alias("source"), none("string").alias("url"), F.lit(4).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("obs_seq")))
    if sales is not None:
        parts.append(sales.select("record_id", "date", F.when(F.col("kind") == "past", "sale_past").otherwise("sale").alias("kind"), "price", none("string").alias("source"), none("string").alias("url"), F.lit(0).cast("bigint").alias("b"), F.col("sale_seq").alias("obs_seq")))
    return reduce(DataFrame.unionByName, parts)


#: Parts into which the events of one record are split before the first and last ones are looked for.
SPLITS = 16


def timelines(events: DataFrame, head: int = LIMITS.timeline_head, tail: int = LIMITS.timeline_tail) -> DataFrame:
    """Events in order with their number ``n``, at most ``head`` first and ``tail`` last of a record.

    Every part of a record's events gives its own first and last ones; only these meet, so no record is ordered or gathered whole.
    """
    order = ["date", F.when(F.col("kind") == "sale_past", 0).otherwise(1), "b", "obs_seq", "kind", "url"]
    back = [F.desc_nulls_last(o) if isinstance(o, str) else o.desc_nulls_last() for o in order]
    part = F.pmod(F.xxhash64("date", "kind", "b", "obs_seq", "url", "price"), F.lit(SPLITS))

    def ends(rows: DataFrame, *keys: str) -> DataFrame:
        up, down = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*back)
        return rows.withColumns({"__u": F.row_number().over(up), "__d": F.row_number().over(down)})

    totals = events.groupBy(F.col("record_id").alias("__r")).agg(F.count(F.lit(1)).alias("total"))
    few = ends(events.withColumn("__s", part), "record_id", "__s").filter((F.col("__u") <= head + tail) | (F.col("__d") <= tail)).drop("__u", "__d", "__s")
    ranked = ends(few, "record_id").join(totals, F.col("record_id").eqNullSafe(F.col("__r")))
    whole = F.col("total") <= head + tail
    kept = ranked.filter(whole | (F.col("__u") <= head) | (F.col("__d") <= tail))
    return kept.withColumn("n", F.when(whole | (F.col("__u") <= head), F.col("__u")).otherwise(F.col("total") - F.col("__d") + 1)).drop("b", "obs_seq", "total", "__u", "__d", "__r")


def ordered_union(old: Column, new: Column, most: int) -> Column:
    """First ``most`` distinct elements of two arrays, old ones first."""
    return F.slice(F.array_distinct(F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()))), 1, most)


def append_observations(log: DataFrame, new: DataFrame) -> DataFrame:
    """``log`` with the rows of ``new`` whose (record, date, address) it lacks, the first of each kept, numbered on from the record's last."""
    fresh = first_sightings(new, ["record_id", "date", "url"], ["obs_seq"]).alias("n")
    known = log.select("record_id", "date", "url").distinct().alias("k")
    same = (F.col("n.record_id") == F.col("k.record_id")) & F.col("n.date").eqNullSafe(F.col("k.date")) & F.col("n.url").eqNullSafe(F.col("k.url"))
    fresh = fresh.join(known, same, "left_anti").join(log.groupBy("record_id").agg(F.max("obs_seq").alias("__last")), "record_id", "left")
    w = Window.partitionBy("record_id").orderBy("obs_seq")
    fresh = fresh.withColumn("obs_seq", F.coalesce("__last", F.lit(0)) + F.row_number().over(w)).drop("__last")
    return log.unionByName(fresh)


def url_index(log: DataFrame) -> DataFrame:
    """The record each address belongs to: the one that saw it last in record order."""
    return log.filter("url is not null").groupBy("url").agg(F.max_by("record_id", F.struct("record_id", "obs_seq")).alias("record_id"))


def match_by_photo(cards: DataFrame, records: DataFrame, threshold: int = LIMITS.photo_bits) -> DataFrame:
    """``seq, record_id``: for each card the first record of its type within one square metre with a photo in common; lower bucket first, then record order."""
    at = lambda t, b: F.concat_ws("/", t, b.cast("string"))
    near = records.select("record_id", "record_ord", "type", "hashes", area_bucket(F.col("area")).alias("r_bucket"))
    probe = cards.select("seq", "type", "phashes", area_bucket(F.col("area")).alias("bucket"))
    sent = probe.filter("type is not null and bucket is not null").withColumn("b", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)]))).select(F.col("seq").alias("id"), at("type", F.col("b")).alias("block"), F.col("phashes").alias("hashes"))
    held = near.filter("type is not null and r_bucket is not null").select(F.col("record_id").alias("id"), at("type", F.col("r_bucket")).alias("block"), "hashes")
    met = photo_links(sent, held, threshold).toDF("seq", "record_id")
    ranked = met.join(near.select("record_id", "record_ord", "r_bucket"), "record_id")
    return ranked.groupBy("seq").agg(F.min_by("record_id", F.struct("r_bucket", "record_ord", "record_id")).alias("record_id"))


def match_cards(cards: DataFrame, records: DataFrame, log: DataFrame, threshold: int = LIMITS.photo_bits) -> DataFrame:
    """``seq, record_id, how``: photo match first, then the address if galleries do not contradict; developers' cards by address only; null is a new record."""
    photo = match_by_photo(cards.filter(~F.coalesce("development", F.lit(False))), records, threshold).select("seq", F.col("record_id").alias("p"))
    known = url_index(log).join(records.select("record_id", "hashes"), "record_id").select(F.col("url").alias("k_url"), F.col("record_id").alias("u"), "hashes")
    joined = cards.join(photo, "seq", "left").join(known, F.col("url") == F.col("k_url"), "left")
    blind = F.coalesce(F.size("phashes"), F.lit(0)) * F.coalesce(F.size("hashes"), F.lit(0)) <= 0
    by_url = F.when(blind | same_photos(F.col("phashes"), F.col("hashes"), threshold) | F.coalesce("development", F.lit(False)), F.col("u"))
    return joined.select("seq", F.coalesce("p", by_url).alias("record_id"), F.when(F.col("p").isNotNull(), "photo").when(by_url.isNotNull(), "url").otherwise("new").alias("how"))


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field the new value unless it is missing; rows of either side stay."""
    o, n = old.select(key, *[F.col(f).alias(f"o_{f}") for f in fields]), new.select(key, *[F.col(f).alias(f"n_{f}") for f in fields])
    present = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return o.join(n, key, "full").select(key, *[F.coalesce(present(f"n_{f}"), F.col(f"o_{f}")).alias(f) for f in fields])


def stale_records(log: DataFrame, active: DataFrame, today: Column, grace: int = LIMITS.grace_days, most: int = LIMITS.checks_per_run, records: DataFrame | None = None) -> DataFrame:
    """The ``most`` records longest unseen, at least ``grace`` days, none of whose addresses is active: a bounded day's work.

    With ``records``, those already delisted and developments are left out.
    """
    live = log.join(active.select("url").distinct(), "url", "left_semi").select("record_id").distinct()
    last = last_sighting(log).join(live, "record_id", "left_anti").filter((F.col("date") < F.date_sub(today, grace)) & F.col("url").isNotNull())
    if records is not None:
        last = last.join(records.filter(F.col("delisted").isNull() & ~F.coalesce("development", F.lit(False))).select("record_id"), "record_id", "left_semi")
    return last.select("record_id", "date", "url").orderBy("date", "url", "record_id").limit(most)


def gone(status: Column, redirected: Column, final_url: Column, body: Column, marker: str, index: str) -> Column:
    """Whether a fetched page says its advertisement is gone: true, false, or null when the fetch tells nothing."""
    return F.when(status.isin(404, 410), True).when(redirected & final_url.rlike(index), True).when(status != 200, F.lit(None).cast("boolean")).when(status.isNull(), F.lit(None).cast("boolean")).otherwise(body.rlike(marker))


def archive(records: DataFrame, log: DataFrame, sales: DataFrame | None = None, most_urls: int = LIMITS.stored_urls) -> DataFrame:
    """Delisted records that are no developments, as cards of the archive, latest delisted first.

    Snapshot fields first, else those of the last sighting; the price the other way round, where 0 is none. ``sold`` is the
    last confirmed sale of ``sales`` (``record_id, sale_seq, date, price, kind``, further columns are carried), ``timeline`` the capped events.
    """
    gone_ = records.filter(F.col("delisted").isNotNull() & ~F.coalesce("development", F.lit(False)))
    ids = gone_.select("record_id")
    own_log = log.join(ids, "record_id", "left_semi")
    last = last_sighting(own_log).select("record_id", F.col("price").alias("last_price"), F.col("url").alias("last_url"), F.col("source").alias("last_source"))
    own_sales = None if sales is None else sales.join(ids, "record_id", "left_semi")
    events = timelines(timeline_events(own_log, gone_.select("record_id", "delisted"), own_sales))
    fields = [c for c in ("n", "date", "kind", "price", "source", "url") if c in events.columns]
    timeline = events.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda e: F.struct(*[e[c].alias(c) for c in fields[1:]])).alias("timeline"))  # capped events only
    out = gone_.join(last, "record_id", "left").join(timeline, "record_id", "left")
    if own_sales is not None:
        told = [c for c in own_sales.columns if c != "record_id"]
        out = out.join(own_sales.filter("kind = 'sold'").groupBy("record_id").agg(F.max_by(F.struct(*told), F.struct("date", "sale_seq")).alias("sold")), "record_id", "left")
    else:
        out = out.withColumn("sold", F.lit(None).cast("struct<date:date,price:bigint,kind:string>"))
    present = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    priced = lambda c: F.when(F.col(c) != 0, F.col(c))
    return out.select(
        "record_id", "type", "area", "title", "image", "locality", "district", "rooms", F.coalesce(present("url"), F.col("last_url")).alias("url"), F.coalesce(present("source"), F.col("last_source")).alias("source"),
        F.coalesce(priced("last_price"), F.col("price")).alias("price"), "first_seen", "delisted", "sold", F.coalesce("timeline", F.array().cast(out.schema["timeline"].dataType)).alias("timeline"),
        F.slice(F.coalesce("photo_urls", F.array().cast("array<string>")), 1, most_urls).alias("photo_urls"),
    ).orderBy(F.desc("delisted"), "record_id")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def touch(old: DataFrame, keys: DataFrame, key: str, today: Column, seen: str = "seen") -> DataFrame:
    """Marks the rows of ``old`` whose key is in ``keys`` as seen today."""
    hit = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    return old.join(hit, key, "left").withColumn(seen, F.when(F.col("__hit"), today).otherwise(F.col(seen))).drop("__hit")


def expire(rows: DataFrame, today: Column, days: int = LIMITS.cache_days, seen: str = "seen") -> DataFrame:
    """Rows seen within ``days``; never seen ones go."""
    return rows.filter(F.col(seen) >= F.date_sub(today, days))
