"""Serving: conjunctive card filters, sorts, pages, facets, discounts, summaries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.numbers import haversine_km

CHOICES = {"type": ("all", "house", "flat"), "owner": ("all", "private", "agency"), "history": ("all", "relisted", "rcn", "dropped", "sold", "sold_rcn"), "market": ("all", "primary", "secondary"), "sort": ("newest", "discount", "price_asc", "price_desc", "ppm_asc", "area_desc")}
_WIRE = {"min_price": "minPrice", "max_price": "maxPrice", "min_area": "minArea", "max_area": "maxArea", "min_rooms": "minRooms"}
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


@dataclass(frozen=True)
class CardQuery:
    """What a visitor asks for. Unknown choices fall back to the first; numbers that are none are no filter."""

    type: str = "all"
    source: str = "all"
    owner: str = "all"
    history: str = "all"
    market: str = "all"
    distance: str | float | None = None
    sort: str = "newest"
    localities: tuple[str, ...] = field(default_factory=tuple)
    min_price: str | float | None = None
    max_price: str | float | None = None
    min_area: str | float | None = None
    max_area: str | float | None = None
    min_rooms: str | float | None = None
    q: str = ""

    def to_json(self) -> str:
        return json.dumps({_WIRE.get(k, k): list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "CardQuery":
        try:
            given = json.loads(text)
        except (TypeError, ValueError):
            return cls()
        own = {v: k for k, v in _WIRE.items()}
        names = {f.name for f in fields(cls)}
        known = {own.get(k, k): v for k, v in given.items() if own.get(k, k) in names} if isinstance(given, dict) else {}
        known["localities"] = tuple(known.get("localities") or ())
        for k, allowed in CHOICES.items():
            if known.get(k) not in allowed:
                known.pop(k, None)
        return cls(**known)

    def active(self) -> dict:
        """The filters that are not at their default."""
        plain = CardQuery()
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) not in (getattr(plain, f.name), "", None) and f.name != "sort"}

    def reset(self, name: str | None = None) -> "CardQuery":
        return CardQuery(sort=self.sort) if name is None else replace(self, **{name: getattr(CardQuery(), name)})

    def number(self, name: str) -> float | None:
        """The number a field begins with ("12 tys" is 12), or None."""
        given = getattr(self, name)
        begins = None if given is None or isinstance(given, bool) else _NUMBER.match(str(given))
        x = float(begins.group(1)) if begins else None
        return x if x is not None and abs(x) != float("inf") else None

    @property
    def in_archive(self) -> bool:
        """Whether the visitor looks at properties that left the market."""
        return self.history in ("sold", "sold_rcn")


def city(locality: Column, city_of: dict[str, str]) -> Column:
    """A locality, or the city of which it is a district; null if blank."""
    named = F.when(locality != "", locality)
    if not city_of:
        return named
    known = F.create_map(*[F.lit(x) for kv in city_of.items() for x in kv])
    return F.coalesce(F.try_element_at(known, named), named)


def with_distance(cards: DataFrame, places: DataFrame, home: tuple[float, float], city_of: dict[str, str] | None = None) -> DataFrame:
    """``cards`` with ``distance_km`` from ``home`` (latitude, longitude) by the coordinates of their town (``places``: town, lat, lon); null if unknown."""
    p = places.dropDuplicates(["town"]).select(F.col("town").alias("__town"), haversine_km(F.lit(home[0]), F.lit(home[1]), F.col("lat"), F.col("lon")).alias("distance_km"))
    return cards.withColumn("__at", city(F.col("locality"), city_of or {})).join(p, F.col("__at") == F.col("__town"), "left").drop("__at", "__town")


def matches(query: CardQuery, columns: list[str], city_of: dict[str, str] | None = None) -> Column:
    """The conjunction a query stands for, over the columns a table has; simple comparisons reach the scan.

    A filter on a column that the table lacks raises. Only ``development`` may be absent (then no card is one), and
    ``sources``, for which ``source`` stands in. In the archive the owner is not asked for.
    """
    has, out = set(columns), F.lit(True)

    def c(name: str) -> Column:
        if name not in has:
            raise ValueError(f"the query filters by {name}, which the table does not have")
        return F.col(name)

    if query.type != "all":
        out = out & (c("type") == query.type)
    if query.source != "all":
        out = out & (F.array_contains("sources", query.source) if "sources" in has else c("source") == query.source)
    if query.owner != "all" and not query.in_archive:
        out = out & c("is_private").eqNullSafe(F.lit(query.owner == "private"))
    if query.market != "all":
        dev = F.coalesce(c("development"), F.lit(False)) if "development" in has else F.lit(False)
        out = out & (dev if query.market == "primary" else ~dev)
    if query.history == "sold_rcn":
        out = out & c("sold").isNotNull()
    if query.history == "relisted":
        out = out & F.coalesce(c("relisted"), F.lit(False))
    if query.history == "rcn":
        out = out & F.coalesce(F.size(c("sales")) > 0, F.lit(False))
    if query.history == "dropped":
        out = out & price_dropped(c("price_history"))
    if query.localities:
        out = out & city(c("locality"), city_of or {}).isin(*query.localities)
    for name, column, op in (("min_price", "price", "ge"), ("max_price", "price", "le"), ("min_area", "area", "ge"), ("max_area", "area", "le"), ("min_rooms", "rooms", "ge"), ("distance", "distance_km", "le")):
        x = query.number(name)
        if x is not None:
            out = out & (c(column) >= x if op == "ge" else c(column) <= x)
    if query.q.strip():
        texts = [F.coalesce(c(x), F.lit("")) for x in ("title", "locality", "district")]
        out = out & F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(query.q.strip().lower()))
    return F.coalesce(out, F.lit(False))


def price_dropped(prices: Column) -> Column:
    """At least two known prices, the last below the highest."""
    known = F.filter(prices, lambda p: p.isNotNull())
    return F.coalesce((F.size(known) >= 2) & (F.try_element_at(known, F.lit(-1)) < F.array_max(known)), F.lit(False))


def discount(price: Column, highest: Column, floor: int = 10_000) -> tuple[Column, Column]:
    """(percent, amount) below the highest price known; zero for missing or implausibly low prices."""
    base = F.greatest(highest, price)
    off = F.when(price >= floor, base - price).otherwise(0)
    return F.when((price >= floor) & (base > 0), off / base * 100).otherwise(F.lit(0.0)), F.coalesce(off, F.lit(0))


def discount_percent(columns: list[str]) -> Column:
    """Percent a card's price is below the highest known of it: of its trail, the price before and the highest offer, as far as the table has them."""
    has, prices = set(columns), [F.col("price")]
    if "price_history" in has:
        prices.append(F.array_max("price_history"))
    prices += [F.col(c) for c in ("prev_price", "price_max") if c in has]
    return discount(F.col("price"), F.greatest(*prices) if len(prices) > 1 else prices[0])[0]


def ordered(cards: DataFrame, sort: str = "newest", archive: bool = False) -> DataFrame:
    """One of the six orders; missing values last, ties by seq (in the archive by url). Newest in the archive is latest delisted."""
    has = set(cards.columns)
    latest = lambda c: F.desc_nulls_last(F.nullif(F.col(c).cast("string"), F.lit("")))
    order = {
        "newest": lambda: latest("delisted" if archive else "created"), "discount": lambda: F.desc_nulls_last("discount_pct") if "discount_pct" in has else F.desc_nulls_last(discount_percent(cards.columns)),
        "price_asc": lambda: F.asc_nulls_last("price"), "price_desc": lambda: F.desc_nulls_last("price"), "ppm_asc": lambda: F.asc_nulls_last("price_per_m2"), "area_desc": lambda: F.desc_nulls_last("area"),
    }
    return cards.orderBy(order[sort](), *[c for c in ("seq", "archive_id", "record_id", "url") if c in has][:1])


def page(cards: DataFrame, number: int, size: int = 60) -> DataFrame:
    return cards.offset(number * size).limit(size)


def run_query(cards: DataFrame, query: CardQuery, archive: DataFrame | Callable[[], DataFrame] | None = None, city_of: dict[str, str] | None = None) -> DataFrame:
    """The cards, or archived properties, a query asks for, in its order. ``archive`` may be a function: it is called only by queries that look there."""
    pool = cards
    if query.in_archive:
        if archive is None:
            raise ValueError("a query for sold properties needs the archive")
        pool = archive() if callable(archive) else archive
    return ordered(pool.filter(matches(query, pool.columns, city_of)), query.sort, query.in_archive)


def facets(cards: DataFrame, column: str, city_of: dict[str, str] | None = None, collation: str | None = None) -> DataFrame:
    """``value, n``: how many cards each value of a column has, most first, then by value in the order of ``collation``; arrays count each element.

    With ``city_of`` a district counts for its city.
    """
    value = F.explode(column) if dict(cards.dtypes)[column].startswith("array") else city(F.col(column), city_of) if city_of is not None else F.col(column)
    tie = F.collate(F.col("value"), collation) if collation else F.col("value")
    return cards.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), tie)


def summary(listing: DataFrame) -> DataFrame:
    """One row of counts in a single pass."""
    return listing.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("type") == "house").alias("houses"), F.count_if(F.col("type") == "flat").alias("flats"),
        F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"), F.count_if(F.col("is_private")).alias("private"), F.count_if(F.col("price").isNotNull() & (F.col("price") > 0)).alias("priced"),
    )


def price_label(price: Column, price_max: Column) -> Column:
    """``price`` or ``price - price_max`` when they differ."""
    return F.when(price_max.isNotNull() & ~price.eqNullSafe(price_max), F.concat_ws(" - ", price.cast("string"), price_max.cast("string"))).otherwise(price.cast("string"))


def last_past_sale(sales: Column) -> Column:
    """The last earlier sale with a price of an array of sales."""
    return F.try_element_at(F.filter(sales, lambda s: (s["kind"] == "past") & (s["price"] > 0)), F.lit(-1))


def offer_lines(offers: Column, cheapest_url: Column) -> Column:
    """Offers of a card with a mark on the cheapest, when there are several at different prices; else null."""
    known = F.filter(F.transform(offers, lambda o: o["price"]), lambda p: p.isNotNull())
    differ = F.array_max(known) > F.array_min(known)
    return F.when(F.size(offers) >= 2, F.transform(offers, lambda o: F.struct(o["source"].alias("source"), o["price"].alias("price"), F.coalesce(differ & (o["url"] == cheapest_url), F.lit(False)).alias("best"))))


def history_line(relisted: Column, pct: Column, also_listed: Column, trail: Column, prev_price: Column) -> Column:
    """What a card says of its past, strongest first: discount of a percent or more, other advertisements, price trail, earlier price."""
    known = F.coalesce(F.size(also_listed), F.lit(0)) > 0
    past = F.when(known, F.lit("also_listed")).when(F.coalesce(F.size(trail), F.lit(0)) > 1, F.lit("trail")).when(prev_price.isNotNull(), F.lit("previous"))
    return F.array_compact(F.array(F.when(relisted, F.lit("relisted")), F.when(pct >= 1, F.lit("discount")), past))


def banner(sales: Column, delisted: Column) -> Column:
    """Price of the last confirmed sale, else the day of the delisting, as text; null for live cards."""
    sold = F.try_element_at(F.filter(sales, lambda s: (s["kind"] == "sold") & (s["price"] > 0)), F.lit(-1))
    return F.coalesce(F.concat(F.lit("sold "), sold["price"].cast("string")), F.concat(F.lit("gone "), delisted.cast("string")))


def timeline_shown(events: Column, photos: Column, sales: Column) -> Column:
    """A timeline is worth showing with two events, a photo or a sale."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (n(events) >= 2) | (n(photos) > 0) | (n(sales) > 0)
