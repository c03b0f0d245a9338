"""Numbers out of text, and rounding that agrees with half-even everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals one to ten in order.
NUMERALS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
# Storeys written as words (an attic has no number).
FLOOR_WORDS = {"parter": 0, "suterena": -1}
ATTIC = "poddasze"


def to_float(text: Column) -> Column:
    """Number written in Polish style: blanks dropped, decimal comma, other signs ignored; null if none is left."""
    kept = F.regexp_replace(F.translate(text, ",", "."), r"[^0-9.\-]", "")
    return kept.try_cast("double")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def to_int(text: Column) -> Column:
    """:func:`to_float` rounded half to even."""
    return half_even(to_float(text)).cast("bigint")


def truncated_int(text: Column) -> Column:
    """Integer part of a plain decimal text, null if it is none."""
    return text.try_cast("double").cast("int")


def rooms_from_word(text: Column) -> Column:
    """Rooms out of digits or an English numeral in any case."""
    words = F.create_map(*[F.lit(x) for i, w in enumerate(NUMERALS, 1) for x in (w, i)])
    bare = F.lower(F.trim(text))
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")).otherwise(F.try_element_at(words, bare))


def price_before_unit(text: Column, unit: str = "zł") -> Column:
    """The number before the first currency unit."""
    return to_int(F.substring_index(text, unit, 1))


def floor_number(text: Column) -> Column:
    """Storey as a number: words for ground floor and basement, else the first signed digits; attics are null."""
    bare = F.lower(F.trim(text))
    out = F.when(bare == ATTIC, F.lit(None).cast("int"))
    for word, n in FLOOR_WORDS.items():
        out = out.when(bare == word, n)
    return out.otherwise(F.regexp_extract(bare, r"(-?[0-9]+)", 1).try_cast("int"))


def has_decimals(area: Column) -> Column:
    """Whether an area is measured finer than to whole square metres."""
    return F.abs(area - half_even(area)) > F.lit(0.01)


def area_key(area: Column) -> Column:
    """Area in hundredths, as a key that is equal exactly when the areas are."""
    return half_even(area * 100).cast("bigint")


def area_bucket(area: Column) -> Column:
    return half_even(area).cast("bigint")


def price_per_m2(price: Column, area: Column) -> Column:
    return F.when(area > 0, half_even(price / area)).cast("bigint")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in whole kilometres, halves up, on a sphere of 6371 km."""
    rad = lambda c: F.radians(c)
    h = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return F.floor(2 * 6371 * F.asin(F.sqrt(h)) + F.lit(0.5)).cast("bigint")


def in_box(x: Column, y: Column, at_x: float, at_y: float, radius: float) -> Column:
    """Points of a square around a point; pushes down to the scan as four comparisons."""
    return (x >= at_x - radius) & (x <= at_x + radius) & (y >= at_y - radius) & (y <= at_y + radius)
