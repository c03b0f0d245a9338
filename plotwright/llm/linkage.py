"""Entities matched across sources without keys: votes of matching functions under a label model.

Archived properties and notarial deeds share no key. Both are read into kind, official town, street, area,
rooms, price and date. Blocking joins bring together only pairs that keep the exact limits (kind and town,
area, rooms and price where known, days around the delisting): pairs whose sides both name a street share, beside
these, an n-gram of it (the prefix-filtered index of :mod:`addresses`) and reach its cosine; pairs of which a side names none share an
area bin and a price band, so candidates grow with the matches and not with the square of a town. Matching functions vote for,
against or not at all on each candidate. A generative model with a hidden match variable learns
from the vote patterns alone how often each function votes each way for matches and for others; functions whose votes
depend on each other beyond that are merged into joint functions, so that a fact counted twice does not inflate the
confidence. The patterns number at most 3 ** functions, so the model is fitted on their counts over all candidates.
The posterior of a pattern is the confidence of its pairs and decides them; among the pairs it takes, names of streets
that are spelled differently are checked once more word by word.

The hidden variable is "keeps all stated limits": a limit on what one side does not tell (the street) holds, so
``v_street`` votes for such a pair and ``v_named`` has no opinion, which leaves it a lower confidence.

Defined results
---------------
* null type, town, area, delisted or deed date: no pair. Unknown street, rooms or price: that limit holds.
* empty or very long titles: read whole; a title without a street type names no street.
* repeated rows pair separately; empty tables give an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import fold_py
from plotwright.llm.addresses import Grams, Vectors, given_conflict, gram_weights, main_words, read_street, same_street
from plotwright.llm.canonical import district_segments, reference_names, resolve_values
from plotwright.operators.skew import lookup_join
from plotwright.session import materialize

AREA, EARLY, LATE, PRICE = 0.6, 60, 400, 0.12
#: Index terms of street names: here 3-grams, which few names share by chance.
GRAMS = Grams(3, 0.36, 0.1, 0.02)
#: Cosine of two street names from which the n-grams speak for one street.
ALIKE = 0.6
FUNCTIONS = ("v_street", "v_grams", "v_given", "v_named", "v_area", "v_rooms", "v_price", "v_date")
#: Posterior from which a pair is a match.
CUT = 0.5


class LabelModel:
    """Two hidden classes, conditionally independent blocks of ternary votes, fitted by expectation-maximisation."""

    def __init__(self, n_functions: int, rounds: int = 200, excess: float = 0.02, copies: float = 0.2, widest: int = 3) -> None:
        self.m, self.rounds, self.excess, self.copies, self.widest = n_functions, rounds, excess, copies, widest
        self.blocks = [(j,) for j in range(n_functions)]

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        digits = votes + 1
        return [sum(digits[:, j] * 3**k for k, j in enumerate(b)) for b in self.blocks]

    def _fit_blocks(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        codes = self._codes(votes)
        q = self._majority(votes)
        for _ in range(self.rounds):
            w = np.stack([counts * (1 - q), counts * q])
            self.prior = np.clip(w.sum(axis=1) / counts.sum(), 1e-6, 1)
            self.tables = []
            for b, code in zip(self.blocks, codes):
                t = np.stack([np.bincount(code, weights=w[y], minlength=3 ** len(b)) + 0.1 for y in (0, 1)])
                self.tables.append(t / t.sum(axis=1, keepdims=True))
            new = self.posterior(votes)
            done = np.abs(new - q).max() < 1e-9
            q = new
            if done:
                break
        return q

    def _majority(self, votes: np.ndarray) -> np.ndarray:
        """Starting point: each block has one say, votes against weigh more."""
        say = sum(np.sign(votes[:, list(b)].sum(axis=1)) for b in self.blocks)
        return 1 / (1 + np.exp(-(say - 2.0 * (votes == -1).any(axis=1))))

    def fit(self, votes: np.ndarray, counts: np.ndarray) -> "LabelModel":
        """Fit accuracies; functions that depend on each other given the class are merged into joint blocks.

        Near copies would draw the hidden class to themselves, so they are merged by their dependence under
        the majority first; the rest are merged until none exceeds ``excess`` nats under the fitted model.
        """
        votes, counts = votes.astype(np.int64), counts.astype(float)
        while self._merge(votes, counts, self._majority(votes), self.copies):
            pass
        while self._merge(votes, counts, self._fit_blocks(votes, counts), self.excess):
            pass
        return self

    def _merge(self, votes: np.ndarray, counts: np.ndarray, q: np.ndarray, limit: float) -> bool:
        """Join the most dependent pair of blocks if it exceeds ``limit``. Joint blocks hold ``widest`` functions at most: two hidden classes are not told apart by fewer than three blocks."""
        pairs = [(self._dependence(votes, counts, q, a, b), a, b) for a, b in itertools.combinations(range(len(self.blocks)), 2) if len(self.blocks[a]) + len(self.blocks[b]) <= 3]
        worst, a, b = max(pairs, default=(0.0, 0, 0))
        if worst <= limit:
            return False
        self.blocks = [x for k, x in enumerate(self.blocks) if k not in (a, b)] + [self.blocks[a] + self.blocks[b]]
        return True

    def _dependence(self, votes, counts, q, a: int, b: int) -> float:
        """Mutual information of two blocks given the class."""
        code = self._codes(votes)
        na, nb, out = 3 ** len(self.blocks[a]), 3 ** len(self.blocks[b]), 0.0
        for w in (counts * (1 - q), counts * q):
            joint = np.bincount(code[a] * nb + code[b], weights=w, minlength=na * nb).reshape(na, nb)
            total = joint.sum()
            if total > 0:
                p = joint / total
                expected = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
                m = p > 0
                out += total / counts.sum() * float((p[m] * np.log(p[m] / expected[m])).sum())
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + sum(np.log(t[:, code]) for t, code in zip(self.tables, self._codes(votes.astype(np.int64))))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def street_in_title(title: str | None) -> str:
    """Folded words of the street a title names after a street type, or ''."""
    for part in fold_py(title or "").replace(" - ", ",").replace("|", ",").split(","):
        words = part.split()
        for i, w in enumerate(words):
            if w.split(".")[0] in ("ul", "ulica", "ulicy", "al", "aleja", "alei", "pl", "plac", "placu", "os", "osiedle", "osiedlu"):
                name, _, typed = read_street(" ".join(words[i:]))
                if typed and name:
                    return " ".join(name)
    return ""


def _streets(kind: str):
    """Adds ``street``, the words of the street an archived row's title or a deed names, or null, in place of ``named``."""

    def run(batches):
        for b in batches:
            read = street_in_title if kind == "archive" else lambda name: " ".join(read_street(fold_py(name or ""))[0])
            street = [read(x) or None for x in b["named"].to_pylist()]
            cols = [c for c in b.schema.names if c != "named"]
            yield pa.RecordBatch.from_arrays([b[c] for c in cols] + [pa.array(street, pa.string())], names=[*cols, "street"])

    return run


def _index_names(idf: dict[str, float]):
    def run(batches):
        vectors = Vectors(idf, GRAMS)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["name"], b["main"], b["n"], pa.array([vectors.terms(m) for m in b["main"].to_pylist()], pa.list_(pa.string()))], names=["name", "main", "n", "grams"])

    return run


def _street_votes(idf: dict[str, float]):
    """Votes on the street names of pairs, and whether the exact check takes them; pairs whose names are not alike are no candidates."""

    def run(batches):
        vectors, seen = Vectors(idf, GRAMS), {}
        for b in batches:
            keep, out = [], []
            for i, key in enumerate(zip(*(b[c].to_pylist() for c in ("street", "street_d", "main", "main_d")))):
                hit = seen.get(key)
                if hit is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    hit = seen[key] = street_vote(*key, vectors) or ()
                if hit:
                    keep.append(i)
                    out.append(hit)
            cols, at = list(zip(*out)) or [()] * 5, pa.array(keep, pa.int64())
            rest = [c for c in b.schema.names if c not in ("street", "street_d", "main", "main_d")]
            yield pa.RecordBatch.from_arrays([b[c].take(at) for c in rest] + [pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(cols[4], pa.bool_())], names=[*rest, *FUNCTIONS[:4], "exact"])

    return run


def street_vote(street: str | None, street_d: str | None, main: str | None, main_d: str | None, vectors: Vectors) -> tuple[int, int, int, int, bool] | None:
    """(v_street, v_grams, v_given, v_named, exact check) of two street names, null where not named; None if they are not alike."""
    if not street or not street_d:
        return 1, 0, 0, 0, True
    if street == street_d:
        return 1, 1, int(street != main), 1, True
    if not vectors.alike(main, main_d):
        return None
    words = same_street(main, main_d, main, main_d)
    gx, gy = ([w for w in s.split() if w not in m.split()] for s, m in ((street, main), (street_d, main_d)))
    given = 0 if not gx or not gy else -1 if given_conflict(gx, gy) else 1
    return 1 if words else -1, 1 if vectors.cosine(main, main_d) >= ALIKE else 0, given, 1 if words else 0, same_street(street, street_d, main, main_d)


def _numeric_votes() -> dict[str, Column]:
    """Votes on measures within the limits: 1 for, 0 no opinion."""
    says = lambda yes: F.when(yes, 1).otherwise(0).cast("int")
    whole = (F.col("area") == F.bround("area")) & (F.bround("a") == F.col("area"))
    return {
        "v_area": says((F.abs(F.col("area") - F.col("a")) <= 0.05) | whole),
        "v_rooms": says(F.col("rooms") == F.col("izb")),
        "v_price": says((F.col("price") > 0) & (F.abs(F.col("c") - F.col("price")) <= 0.05 * F.col("price"))),
        "v_date": says(F.datediff("d", "delisted").between(-30, 180)),
    }


def _within_limits() -> Column:
    """The exact limits, as far as both sides tell; kind and town are keys."""
    priced = (F.col("price") > 0) & F.col("c").isNotNull()
    rooms = F.col("rooms").isNull() | F.col("izb").isNull() | (F.col("rooms") == F.col("izb"))
    price = ~F.coalesce(priced, F.lit(False)) | (F.abs(F.col("c") - F.col("price")) <= PRICE * F.col("price") + 1e-9)
    return (F.abs(F.col("area") - F.col("a")) <= AREA + 1e-9) & F.datediff("d", "delisted").between(-EARLY, LATE) & rooms & price


def _blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates: pairs within the limits whose streets share an index term, or of which a side names no street."""
    wide = 1e-6  # for rounding; a bin is a little wider than the span of a row, so the span meets two bins at most
    width, band = 2 * AREA + 4 * wide, float(np.log((1 + PRICE) / (1 - PRICE))) + wide
    bins = F.array_distinct(F.array(F.floor((F.col("area") - AREA - wide) / width), F.floor((F.col("area") + AREA + wide) / width)))
    left, right = left.withColumn("bin", F.explode(bins)), right.withColumn("bin", F.floor(F.col("a") / width))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.type") == F.col("y.kind")) & (F.col("x.town") == F.col("y.town_d")) & _within_limits()
    out = ["archive_id", "deed_id", "area", "a", "rooms", "izb", "price", "c", "delisted", "d", "street", "street_d", "main", "main_d"]

    def join(x: DataFrame, y: DataFrame, *keys: str) -> DataFrame:
        hashed = lambda kind, town: F.xxhash64(kind, town, "bin", *keys).alias("key")
        x, y = x.select(*[c for c in x.columns if c not in keys], hashed("type", "town")).drop("grams", "bin"), y.select(*[c for c in y.columns if c not in keys], hashed("kind", "town_d")).drop("grams_d", "bin")
        return x.alias("x").hint("merge").join(y.alias("y").hint("merge"), met).select(*out)

    named = join(left.filter("street is not null").withColumn("g", F.explode("grams")), right.filter("street_d is not null").withColumn("g", F.explode("grams_d")), "g").dropDuplicates(["archive_id", "deed_id"])
    # Price bands; a price that is not known meets all (band 0 of a band number of its own), a deed without price meets all.
    any_price, no_price = F.lit(-1_000_000).cast("bigint"), F.lit(-1_000_001).cast("bigint")
    near = lambda k: F.floor(F.log(F.col("price") * k) / band)
    bands = F.when(F.col("price") > 0, F.array_distinct(F.array(near(1 - PRICE - 1e-9), near(1 + PRICE + 1e-9), no_price))).otherwise(F.array(any_price))
    bands_d = F.array_compact(F.array(F.when(F.col("c").isNull(), no_price).otherwise(F.floor(F.log(F.when(F.col("c") > 0, F.col("c"))) / band)), any_price))
    # Sides without a street meet all others (part 0), those with one only sides without (part 1).
    parts = left.withColumn("part", F.when(F.col("street").isNull(), 0).otherwise(1)).withColumn("band", F.explode(bands))
    parts_d = right.withColumn("part", F.explode(F.when(F.col("street_d").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("band", F.explode(bands_d))
    return named.unionByName(join(parts, parts_d, "part", "band"))


def link_deeds(archive: DataFrame, deeds: DataFrame, towns: DataFrame, cut: float = CUT) -> DataFrame:
    """``archive_id, deed_id, confidence, matched``: candidate pairs with the model's posterior, and whether it and the exact check of the streets take them."""
    left = archive.filter(F.col("type").isNotNull() & F.col("area").isNotNull() & F.col("delisted").isNotNull() & F.col("locality").isNotNull()).select("archive_id", "type", "area", "rooms", F.col("price").cast("double").alias("price"), "delisted", F.col("locality").alias("place"), F.col("title").alias("named"))
    right = deeds.filter(F.col("kind").isNotNull() & F.col("a").isNotNull() & F.col("d").isNotNull() & F.col("msc").isNotNull()).select("deed_id", "kind", "a", "izb", F.col("c").cast("double").alias("c"), "d", F.col("msc").alias("place"), F.col("ul").alias("named"))
    places = left.select("place").unionByName(right.select("place")).groupBy(F.col("place").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    resolved = resolve_values(places, reference_names(towns, "loc_id", "name"), district_segments(archive, "district"))
    town_of = materialize(resolved.select(F.col("value").alias("place"), "n", F.when(F.col("entry") != 0, F.concat(F.lit("#"), "entry")).otherwise(F.col("other")).alias("town")).filter("town is not null"), "places")
    left = lookup_join(materialize(left.mapInArrow(_streets("archive"), "archive_id bigint, type string, area double, rooms int, price double, delisted date, place string, street string"), "archive"), town_of, ["place"], "n", ["town"]).drop("place")
    right = lookup_join(materialize(right.mapInArrow(_streets("deed"), "deed_id bigint, kind string, a double, izb int, c double, d date, place string, street string"), "deeds"), town_of, ["place"], "n", ["town"]).drop("place")
    counted = left.select("street").unionByName(right.select("street")).filter("street is not null").groupBy(F.col("street").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "streets")
    names = materialize(main_words(counted.select("name")).join(counted, "name"), "names")
    idf = gram_weights(names, GRAMS.n)
    index = materialize(names.mapInArrow(_index_names(idf), "name string, main string, n bigint, grams array<string>").withColumnRenamed("name", "street"), "index")

    def indexed(side: DataFrame) -> DataFrame:
        bare = side.filter("street is null").withColumns({"main": F.lit(None).cast("string"), "grams": F.lit(None).cast("array<string>")})
        return lookup_join(side.filter("street is not null"), index, ["street"], "n", ["main", "grams"]).unionByName(bare)

    met = _blocks(indexed(left), indexed(right).withColumnsRenamed({c: f"{c}_d" for c in ("street", "town", "main", "grams")}))
    numbers = met.select("archive_id", "deed_id", "street", "street_d", "main", "main_d", *[c.alias(n) for n, c in _numeric_votes().items()])
    votes = numbers.mapInArrow(_street_votes(idf), f"archive_id bigint, deed_id bigint, {', '.join(f'{f} int' for f in (*FUNCTIONS[4:], *FUNCTIONS[:4]))}, exact boolean")
    code = sum(((F.col(f) + 1) * 3**k for k, f in enumerate(FUNCTIONS)), F.lit(0)).cast("int")
    voted = materialize(votes.select("archive_id", "deed_id", code.alias("code"), "exact"), "votes")
    patterns = voted.groupBy("code").count().collect()  # at most 3 ** len(FUNCTIONS) rows
    if not patterns:
        return voted.select("archive_id", "deed_id", F.lit(0.0).alias("confidence"), F.lit(False).alias("matched"))
    codes = np.array([r["code"] for r in patterns])
    pattern = np.stack([codes // 3**k % 3 - 1 for k in range(len(FUNCTIONS))], axis=1)
    confidence = LabelModel(len(FUNCTIONS)).fit(pattern, np.array([r["count"] for r in patterns])).posterior(pattern)
    scores = voted.sparkSession.createDataFrame([(int(k), float(p)) for k, p in zip(codes, confidence)], "code int, confidence double")
    return voted.join(F.broadcast(scores), "code").select("archive_id", "deed_id", "confidence", ((F.col("confidence") >= cut) & F.col("exact")).alias("matched"))
