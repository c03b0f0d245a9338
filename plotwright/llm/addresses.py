"""The same building written differently: weighted character n-grams and a prefix-filtered index.

Each row's street, locality and district are read into town, street name and house number,
whatever field they stand in. Rows with the same reading form one class. The street name of a
class is a vector of character 2-grams weighted by inverse document frequency over distinct names; given names
and the like (:func:`main_words`) carry no weight. An inverted index over (town, house number, 2-gram) holds only each
vector's prefix in the order rarest first: as many 2-grams as needed so that what is left cannot
reach the cosine threshold alone (somewhat over half of them). Towns outside the list may hold typos; they are indexed by
2-grams of their own. Candidates are verified by cosine, then by the edits between the names, agreement of given names or
initials, and town.

Defined results
---------------
* rows that lack street, house number or town in all three fields: no pair.
* flat numbers, districts, street types, titles, case, diacritics and order of words do not matter;
  a letter of the house number does. Blank and null fields count as missing.
* repeated rows are pairs; texts of any length are read whole; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import BLANKS, fold_py
from plotwright.llm.canonical import Resolver, allowed_edits, district_segments, repair, segments
from plotwright.llm.pairs import expand_pairs
from plotwright.operators.skew import lookup_join
from plotwright.session import materialize



class Grams(NamedTuple):
    """Characters of an n-gram, and the cosine that two names must reach: at most, and for names of no letters with its gain per letter (an edit spoils more of a short name)."""

    n: int
    most: float
    short: float
    letter: float

    def least(self, main: str) -> float:
        """Cosine that a name asks of another; a pair must reach what both ask."""
        return min(self.most, self.short + self.letter * len(main))


GRAMS = Grams(2, 0.52, 0.3, 0.02)
#: Number and share of all names added to document frequencies, so that the n-grams of a misspelling do not outweigh the rest of the name.
RARE, SMOOTH = 10, 0.05
#: Official towns at most: the list goes to every task.
TOWNS = 200_000
FIELDS = ("street", "locality", "district")

# Words for kinds of streets.
STREET_TYPES = ("ul", "ulica", "ulicy", "al", "aleja", "aleje", "alei", "pl", "plac", "placu", "os", "osiedle", "osiedlu", "rondo", "rynek", "skwer", "bulwar", "trakt", "szosa")
# Titles of patrons.
TITLES = ("gen", "generala", "mjr", "majora", "prof", "profesora", "dr", "doktora", "ks", "ksiedza", "kpt", "plk", "por", "rtm", "marsz", "marszalka", "sw", "swietego", "swietej", "bp", "abp", "kard", "inz", "hr", "im", "red", "o")
# Months in the genitive, as in street names that are dates.
MONTH_NAMES = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "wrzesnia", "pazdziernika", "listopada", "grudnia")
# Words before a house number and before a flat number.
NUMBER_WORDS = ("nr", "numer", "no", "dom", "bud", "budynek", "domu")
FLAT_WORDS = ("m", "lok", "lokal", "mieszkanie", "mieszk", "miesz", "m-k")


def read_street(text: str) -> tuple[list[str], str, bool]:
    """(words of the name, house number with letter or '', has a street type) of a folded segment."""
    t = re.findall(r"\d+|[a-z]+\.?|/", text)
    typed, number, name, i = False, "", [], 0

    def kinds(i):
        nonlocal typed
        while i < len(t) - 1 and t[i].rstrip(".") in STREET_TYPES:
            typed, i = True, i + 1
        return i

    def house(i):
        letter = ""
        if i + 1 < len(t) and re.fullmatch("[a-z]", t[i + 1]) and not (t[i + 1] in FLAT_WORDS and i + 2 < len(t) and t[i + 2].isdigit()):
            letter = t[i + 1]
        return t[i].lstrip("0") + letter, i + 1 + bool(letter)

    is_date = lambda i: i + 1 < len(t) and t[i].isdigit() and len(t[i]) <= 2 and any(near(t[i + 1], m, 1) for m in MONTH_NAMES)
    i = kinds(i)
    if i < len(t) and t[i].isdigit() and not is_date(i):
        number, i = house(i)
        i = kinds(i)
    if is_date(i):
        name, i = [t[i], t[i + 1]], i + 2
    while i < len(t) and not t[i].isdigit() and t[i] != "/" and t[i].rstrip(".") not in NUMBER_WORDS:
        word = t[i].rstrip(".")
        if word not in TITLES or len(word) == 1:
            name.append(word)
        i += 1
    while i < len(t) and (t[i].rstrip(".") in NUMBER_WORDS or t[i] == "/"):
        i += 1
    if not number and i < len(t) and t[i].isdigit():
        number, i = house(i)
    return name, number, typed


def near(a: str, b: str, k: int) -> bool:
    """Whether two words are at most ``k`` edits apart, a swap of neighbours being one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > k:
            return False
        before, last = last, row
    return last[-1] <= k


class AddressReader:
    """Reads town, street name and house number out of three free fields."""

    def __init__(self, towns: list[tuple[int, str]]) -> None:
        self.towns = Resolver(towns)

    def read(self, street: str | None, locality: str | None, district: str | None, beside=frozenset()) -> tuple[str, str, str] | None:
        """(town key, house number, street words) or None. Known towns are ``#id``, others their folded text; ``beside`` holds names of districts."""
        town, other, name, number = 0, "", [], ""
        if locality and locality.strip():
            town = self.towns.value(locality, beside)
        spare = []
        for field, text in (("street", street), ("locality", locality), ("district", district)):
            for part in self._parts(text):
                digits = re.search(r"\d", part)
                words, n, typed = read_street(part)
                if field == "street" or typed or (digits and words):
                    if not words and n and field == "street":
                        number = number or n
                        continue
                    plain = " ".join(words)
                    if not typed and not n:
                        if plain in beside:
                            continue
                        hit = self.towns.name(part, plain)[1]
                        if hit:
                            town = town or hit
                            continue
                    if not plain:
                        continue
                    if not name or (not number and n):
                        if name and not number and n:
                            spare.append(" ".join(name))
                        name, number = words, number or n
                    else:
                        spare.append(plain)
                elif not town and not other:
                    other = next((b for _, b, outer in segments(part) if b not in beside), "")
        if not town and not other and spare:
            other = spare[0]
        if not name or not number or not (town or other):
            return None
        return (f"#{town}" if town else other), number, " ".join(name)

    def asks(self, *fields: str | None) -> list[str]:
        """All names of which :meth:`read` may want to know whether they are districts."""
        parts = [p for text in fields for p in self._parts(text)]
        names = {" ".join(read_street(p)[0]) for p in parts} | {b for p in parts for _, b, _ in segments(p)} | {b for text in fields for _, b, _ in segments(text or "")}
        return sorted(names - {""})

    def _parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        t = re.sub(r"\b\d{2}-\d{3}\b", " ", fold_py(re.sub(f"[{BLANKS}]+", " ", repair(text))))
        return [p for p in (x.strip() for x in re.split(r"[,;()|]| - ", t)) if re.search("[a-z0-9]", p)]


class _Asked:
    """Stands for the names of districts while these are not known; tells whether one was asked for."""

    def __init__(self) -> None:
        self.asked = False

    def __contains__(self, name: str) -> bool:
        self.asked = True
        return False


def _first_reading(towns):
    """Readings of rows, or, where they depend on what is a district, the names to look up."""

    def run(batches):
        reader, cache = AddressReader(towns), {}
        for b in batches:
            keep, out = [], []
            for i, key in enumerate(zip(*(b[c].to_pylist() for c in FIELDS))):
                hit = cache.get(key)
                if hit is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    beside = _Asked()
                    got = reader.read(*key, beside)
                    hit = cache[key] = (None, None, None, reader.asks(*key)) if beside.asked else (*(got or ("", "", "")), None)
                if hit[3] is not None or hit[0]:
                    keep.append(i)
                    out.append(hit)
            cols = list(zip(*out)) or [()] * 4
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b["seq"].take(at), *(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.string())), *(b[c].take(at) for c in FIELDS)], names=["seq", "town", "number", "name", "asks", *FIELDS])

    return run


def _second_reading(towns):
    def run(batches):
        reader = AddressReader(towns)
        for b in batches:
            keep, out = [], []
            for i, (known, *key) in enumerate(zip(*(b[c].to_pylist() for c in ("known", *FIELDS)))):
                hit = reader.read(*key, frozenset(known or ()))
                if hit:
                    keep.append(i)
                    out.append(hit)
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b["seq"].take(pa.array(keep, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names=["seq", "town", "number", "name"])

    return run


def read_addresses(listing: DataFrame, towns: DataFrame) -> DataFrame:
    """``seq, town, number, name`` of the rows that state street, house number and town. Any value of ``district``, however rare, is a district."""
    listed = town_list(towns)
    some_digit = F.concat_ws(" ", *FIELDS).rlike("[0-9]")
    stated = listing.filter(some_digit).select("seq", *FIELDS)
    first = materialize(stated.mapInArrow(_first_reading(listed), "seq bigint, town string, number string, name string, asks array<string>, street string, locality string, district string"), "read")
    doubtful = first.filter("asks is not null")
    known = doubtful.select("seq", F.explode("asks").alias("segment")).join(district_segments(listing, "district"), "segment", "left_semi").groupBy("seq").agg(F.collect_set("segment").alias("known"))
    second = doubtful.select("seq", *FIELDS).join(known, "seq", "left").mapInArrow(_second_reading(listed), "seq bigint, town string, number string, name string")
    return first.filter("asks is null").select("seq", "town", "number", "name").unionByName(second)


def town_list(towns: DataFrame) -> list[tuple[int, str]]:
    """A list of official towns, counted before it is collected."""
    named = towns.filter(F.col("name").isNotNull()).select("loc_id", "name")
    if named.count() > TOWNS:
        raise ValueError(f"a list of official towns has a bounded size; this one has more than {TOWNS:,} entries")
    return [(r["loc_id"], r["name"]) for r in named.collect()]


def main_words(names: DataFrame) -> DataFrame:
    """``name, main`` of distinct street names: the words that tell the street.

    A word that more names of several words begin with than end with is a given name or the like, and does not tell;
    neither does an initial. A name of nothing else keeps the word that leads other names least. The majority of
    two counts has no threshold, so it means the same in tables of any size.
    """
    words = F.split("name", " ")
    places = names.filter(F.size(words) > 1).select(F.explode(F.array(F.struct(F.get(words, F.lit(0)).alias("w"), F.lit(1).alias("first")), F.struct(F.element_at(words, -1).alias("w"), F.lit(-1).alias("first")))).alias("p")).select("p.w", "p.first")
    leading = places.groupBy("w").agg(F.sum("first").alias("lead")).filter(F.col("lead") > 0)
    each = names.select("name", F.posexplode(words).alias("at", "w"))
    counted = leading.join(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w")
    led = lookup_join(each, counted, ["w"], "n", ["lead"]).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("at", "lead"))).alias("leads"))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.try_element_at("leads", i), F.lit(0)).alias("lead")))
    long = F.filter(placed, lambda p: p["w"].rlike("^[0-9]") | (F.length(p["w"]) > 1))
    least = F.array_min(F.transform(long, lambda p: p["lead"]))
    telling = F.transform(F.filter(long, lambda p: p["w"].rlike("^[0-9]") | (p["lead"] == least)), lambda p: p["w"])
    return names.join(led, "name", "left").select("name", F.array_join(F.when(F.size(telling) > 0, telling).otherwise(words), " ").alias("main"))


def grams(main: str, n: int = GRAMS.n) -> list[str]:
    """Distinct character n-grams of words, with marks at their ends."""
    return sorted({f"^{w}$"[i : i + n] for w in main.split() for i in range(max(1, len(w) + 3 - n))})


def gram_weights(names: DataFrame, n: int = GRAMS.n) -> dict[str, float]:
    """Inverse document frequencies of the n-grams of ``names`` (``main``): at most 38 ** n entries, over a-z, 0-9 and the two marks."""
    total = max(1, names.count())
    each = F.transform(F.split("main", " "), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1))), lambda i: F.substr(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(n))))
    seen = names.select(F.explode(F.array_distinct(F.flatten(each))).alias("g")).groupBy("g").count()
    return {r["g"]: math.log(1 + total / (r["count"] + RARE + SMOOTH * total)) for r in seen.collect()}


def _weights(names: list[str], idf: dict[str, float]) -> dict[str, float]:
    w = {g: idf.get(g, 1.0) for g in names}
    norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
    return {g: x / norm for g, x in w.items()}


def prefix(vector: dict[str, float], threshold: float) -> list[str]:
    """Rarest first, the n-grams whose absence leaves less than ``threshold`` of the unit vector."""
    order, left, out = sorted(vector, key=lambda g: (-vector[g], g)), 1.0, []
    for g in order:
        if left < threshold * threshold:
            break
        out.append(g)
        left -= vector[g] ** 2
    return out


def town_grams(town: str, idf: dict[str, float]) -> list[str]:
    """Index terms of a town outside the list: towns within the edits that :func:`allowed_edits` grants share one.

    An edit, swaps included, spoils at most n + 1 n-grams, so the first ``(n + 1) * edits + 1`` in a common
    order, rarest first, of two such towns have one in common.
    """
    order = sorted(grams(town), key=lambda g: (-idf.get(g, 99.0), g))
    return order[: (GRAMS.n + 1) * allowed_edits(len(town)) + 1]


class Vectors:
    """Unit vectors of street names over their n-grams, kept per name."""

    def __init__(self, idf: dict[str, float], kind: Grams = GRAMS) -> None:
        self.idf, self.kind, self.held = idf, kind, {}

    def of(self, main: str) -> dict[str, float]:
        v = self.held.get(main)
        if v is None:
            if len(self.held) > 100_000:
                self.held.clear()
            v = self.held[main] = _weights(grams(main, self.kind.n), self.idf)
        return v

    def terms(self, main: str) -> list[str]:
        """The n-grams under which a name is indexed: two names that share none do not reach the cosine they ask."""
        return prefix(self.of(main), self.kind.least(main))

    def cosine(self, a: str, b: str) -> float:
        x, y = self.of(a), self.of(b)
        if len(x) > len(y):
            x, y = y, x
        return sum(w * y[g] for g, w in x.items() if g in y)

    def alike(self, a: str, b: str) -> bool:
        """Whether two names reach the cosine that both ask."""
        return a == b or self.cosine(a, b) >= max(self.kind.least(a), self.kind.least(b))


def _index_task(idf, kind):
    def run(batches):
        vectors = Vectors(idf, kind)
        for b in batches:
            lists = [vectors.terms(m) for m in b["main"].to_pylist()]
            places = [[t] if t[0] == "#" else town_grams(t, idf) for t in b["town"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["number"], pa.array(lists, pa.list_(pa.string())), pa.array(places, pa.list_(pa.string()))], names=["id", "number", "grams", "places"])

    return run


def same_street(a: str, b: str, main_a: str, main_b: str) -> bool:
    """Whether two street names are one: main words within few edits, given names or initials not in conflict."""
    x, y, mx, my = a.split(), b.split(), main_a.split(), main_b.split()
    if len(mx) > len(my):
        x, y, mx, my = y, x, my, mx
    left = list(my)
    for w in mx:
        hit = next((v for v in left if v == w), None) or next((v for v in left if not w.isdigit() and near(w, v, 0 if len(w) < 5 else 1 if len(w) < 8 else 2)), None)
        if hit is None:
            return False
        left.remove(hit)
    if any(w.isdigit() for w in left):
        return False
    return not given_conflict([w for w in x if w not in mx], [w for w in y if w not in my] + left)


def given_conflict(gx: list[str], rest: list[str]) -> bool:
    """Whether a given name or initial of one name contradicts all the other name has beside its main words."""
    agree = lambda g, h: g[0] == h[0] and (len(g) == 1 or len(h) == 1 or near(g, h, 2)) or near(g, h, 2) and len(g) > 3
    return any(rest and not any(agree(g, h) for h in rest) for g in gx)


def _verify_task(idf, kind):
    def same_town(a: str, b: str) -> bool:
        return a == b or (a[0] != "#" and b[0] != "#" and near(a, b, allowed_edits(min(len(a), len(b)))))

    def run(batches):
        vectors = Vectors(idf, kind)
        for b in batches:
            keep = []
            for i, (na, nb, ma, mb, ta, tb) in enumerate(zip(*(b[c].to_pylist() for c in ("name_a", "name_b", "main_a", "main_b", "town_a", "town_b")))):
                if vectors.alike(ma, mb) and same_town(ta, tb) and same_street(na, nb, ma, mb):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b["a"].take(at), b["b"].take(at)], names=["a", "b"])

    return run


def address_keys() -> Column:
    """Key of the inverted index for one house number, town (or n-gram of an unlisted town) and n-gram of the street."""
    return F.xxhash64("number", "place", "g")


def same_building_classes(listing: DataFrame, towns: DataFrame, kind: Grams = GRAMS) -> tuple[DataFrame, DataFrame]:
    """(links, members): ``a, b`` of classes of rows with one reading that state the same building, and ``id, seq`` of the classes of several rows.

    A class of one row has the row's seq as its id. No pair within a class is written.
    """
    rows = materialize(read_addresses(listing, towns), "stated")
    traits = ["town", "number", "name"]
    grouped = rows.groupBy(*traits).agg(F.min("seq").alias("id"), F.count(F.lit(1)).alias("n"))
    names = materialize(main_words(rows.select("name").distinct()), "names")
    idf = gram_weights(names, kind.n)
    classes = materialize(grouped.join(names, "name"), "addresses")
    index = classes.select("id", "town", "number", "main").mapInArrow(_index_task(idf, kind), "id bigint, number string, grams array<string>, places array<string>")
    keyed = index.select("id", "number", "grams", F.explode("places").alias("place")).select("id", "number", "place", F.explode("grams").alias("g")).select("id", address_keys().alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    # The planner cannot estimate exploded rows; neither side may be broadcast.
    met = x.hint("merge").join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda s: classes.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("name", "main", "town")])
    links = met.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify_task(idf, kind), "a bigint, b bigint")
    members = materialize(rows.join(classes.filter("n > 1").select(*traits, "id"), traits).select("id", "seq"), "twins")
    return links, members


def same_building_pairs(listing: DataFrame, towns: DataFrame, kind: Grams = GRAMS) -> DataFrame:
    """``seq_a, seq_b`` (seq_a < seq_b): rows that state the same building. ``towns`` has ``loc_id, name``; see the module text."""
    return expand_pairs(*same_building_classes(listing, towns, kind))
