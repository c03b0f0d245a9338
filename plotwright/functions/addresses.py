"""Streets, numbers, parcels and places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwright.functions.text import fold

# Words of a street name that do not tell streets apart.
STREET_NOISE = ("ul", "ulica", "al", "aleja", "pl", "plac", "os", "osiedle", "gen", "sw", "ks", "dr", "prof", "mjr", "kpt", "im")
REGION = "śląskie"


def plain(c: Column) -> Column:
    """Folded text with one space for each sign outside a-z and 0-9, trimmed."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9 ]", " "))


def street_words(c: Column) -> Column:
    """The telling words of a street name."""
    return F.filter(F.split(plain(c), r"\s+"), lambda t: (t != "") & ~t.isin(*STREET_NOISE) & ~t.rlike("^[0-9]+$"))


def words_agree(a: Column, b: Column) -> Column:
    """Equal, or one inflected form of the other: at least four letters and all but the last of the shorter in common, at most three letters left over in the longer."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    common = F.when(F.substr(a, F.lit(1), short) == F.substr(b, F.lit(1), short), short).when(F.substr(a, F.lit(1), short - 1) == F.substr(b, F.lit(1), short - 1), short - 1)
    return (a == b) | F.coalesce((common >= 4) & (long - common <= 3), F.lit(False))


def word_lists_agree(wa: Column, wb: Column) -> Column:
    """Whether two lists of telling words name one street: last words agree, every other word of the shorter agrees with one of the longer."""
    shorter = F.size(wa) <= F.size(wb)
    few, many = F.when(shorter, wa).otherwise(wb), F.when(shorter, wb).otherwise(wa)
    rest = F.slice(few, F.lit(1), F.greatest(F.size(few) - 1, F.lit(0)))
    told = F.coalesce((F.size(wa) > 0) & (F.size(wb) > 0), F.lit(False))
    return told & words_agree(F.try_element_at(few, F.lit(-1)), F.try_element_at(many, F.lit(-1))) & F.forall(rest, lambda t: F.exists(many, lambda u: words_agree(t, u)))


def streets_agree(a: Column, b: Column) -> Column:
    """:func:`word_lists_agree` for street names; where pairs outnumber names, take the words before the join instead."""
    return word_lists_agree(street_words(a), street_words(b))


def house_number(c: Column) -> Column:
    """A house number reduced to digits, letters and slashes."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z/]", "")


def numbers_agree(a: Column, b: Column) -> Column:
    return F.coalesce((house_number(a) == house_number(b)) & (house_number(a) != ""), F.lit(False))


def place_parts(location: Column, region: str = REGION) -> Column:
    """Parts of a breadcrumb from narrow to broad, without the region."""
    return F.filter(F.transform(F.split(F.replace(location, F.lit(region), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def town_of_place(location: Column, region: str = REGION, cities: tuple[str, ...] = ()) -> Column:
    """The broadest part; a part that begins with one of ``cities`` is that city."""
    last = F.try_element_at(place_parts(location, region), F.lit(-1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for city in cities:
        out = out.when(F.startswith(last, F.lit(city)), F.lit(city))
    return out.otherwise(last)


def district_of_place(location: Column, region: str = REGION) -> Column:
    parts = place_parts(location, region)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", "))


def dotted_date(text: Column) -> Column:
    """First ``YYYY.MM.DD`` as an ISO text."""
    got = F.regexp_extract(text, r"([0-9]{4}\.[0-9]{2}\.[0-9]{2})", 1)
    return F.when(got != "", F.replace(got, F.lit("."), F.lit("-")))


def register_field(address: Column, key: str) -> Column:
    """A field of ``MSC:..;UL:..;NR_PORZ:..``; null when absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(address, rf"(?:^|;){key}:([^;]*)", 1)), F.lit(""))


def parcel_of_unit(unit: Column) -> Column:
    """The parcel a building or flat stands on: its identifier up to the building part."""
    return F.nullif(F.trim(F.substring_index(unit, "_BUD", 1)), F.lit(""))


def merged_town(locality: Column, districts: list[str], city: str) -> Column:
    """A district given as a town is its city."""
    return F.when(locality.isin(*districts), F.lit(city)).otherwise(locality) if districts else locality
