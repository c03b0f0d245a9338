"""Best representative of each duplicate group, and the truth of its values.

:func:`survivors` picks one surviving row per group field by field, by completeness, trust and
recency. :func:`judge_values` keeps, per group and field, every value that a latent two-sided
quality model judges true: each source has a sensitivity (share of true values it states) and a
specificity (share of false values it withholds) per field; expectation-maximisation alternates
between the probability of each claimed value and the sources' qualities. Several values of one
field can be true. Claims are reduced to patterns (field, sources that state the value, sources that
take part in the group without stating it); the model is fitted on their counts by sums per source, and every source
has qualities of its own, however many there are.

Defined results
---------------
* members that are not in the listing are left out; groups without any present member have no row.
* repeated membership counts once. Null or blank fields count as missing; null or unreadable
  ``created`` is earlier than any other and ``created_ms`` is null if no member has one.
* ties: more trusted source (a source without rank comes last), later created, smaller seq.
* price null if no member has one above 0; source null only if all members' sources are null.
* empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import BLANKS, fold_words
from plotwright.operators.timestamps import normalize_instants
from plotwright.session import materialize

FILLED = ("title", "area", "rooms", "floor", "locality", "district", "street", "agency", "image")
JUDGED = ("price", "area", "title", "image", "rooms", "floor", "locality", "district", "street", "agency")
LAST_RANK = 2**31 - 1
#: Patterns that the driver fetches at most; more stay where they are, and rounds are jobs over them.
LOCAL_PATTERNS = 50_000
#: Sources at most: their qualities are held on the driver and sent to the tasks.
SOURCES = 100_000


def _pairs(dup_group: DataFrame) -> DataFrame:
    return dup_group.select("group_id", "seq").filter(F.col("group_id").isNotNull() & F.col("seq").isNotNull()).distinct()


def _members(dup_group: DataFrame, listing: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per group and present member: number of filled fields, price, source, rank and created_ms."""
    filled = sum(map(_filled, FILLED[1:]), _filled(FILLED[0])).alias("filled")
    rows = materialize(listing.select("seq", "price", "source", "created", filled).join(_pairs(dup_group), "seq"), "members")
    instants = normalize_instants(rows.select("seq", "source", "created").distinct()).select("seq", "created_ms")
    ranks = trust.filter(F.col("source").isNotNull()).groupBy("source").agg(F.min("rank").alias("rank"))
    return rows.join(instants, "seq", "left").join(ranks, "source", "left").withColumn("rank", F.coalesce("rank", F.lit(LAST_RANK)))


def _filled(c: str) -> Column:
    x = F.col(c).cast("string")
    return F.when(x.isNotNull() & (F.regexp_replace(x, f"[{BLANKS}]+", "") != ""), 1).otherwise(0)


def survivors(dup_group: DataFrame, listing: DataFrame, trust: DataFrame) -> DataFrame:
    """``group_id, seq, price, source, created_ms``: the surviving row of each group.

    Everything is a minimum or maximum over structs, which is pre-aggregated before the shuffle, so a group
    with a third of all rows is no burden.
    """
    m = _members(dup_group, listing, trust)
    age = -F.coalesce("created_ms", F.lit(-(2**62)))  # smaller is later
    best = F.struct((-F.col("filled")).alias("f"), "rank", age.alias("t"), "seq")
    priced = F.when(F.col("price") > 0, F.struct(age.alias("t"), "rank", "seq", "price"))
    trusted = F.when(F.col("source").isNotNull(), F.struct("rank", "source"))
    return (
        m.groupBy("group_id")
        .agg(F.min(best).alias("b"), F.min(priced).alias("p"), F.min(trusted).alias("s"), F.max("created_ms").alias("created_ms"))
        .select("group_id", F.col("b.seq").alias("seq"), F.col("p.price").cast("bigint").alias("price"), F.col("s.source").alias("source"), "created_ms")
    )


class TwoSidedTruth:
    """Sensitivity and specificity of sources by expectation-maximisation over vote patterns.

    A value that no source states leaves no pattern, so patterns count as drawn from the stated ones
    and the unseen values are added back in expectation; else sources would look less silent than they are.
    A round needs of the patterns only sums per source, so patterns may lie in any number of parts (:meth:`sums`).
    """

    #: Sums of a round: over stated patterns, over those taken part in, of true and false and of unseen values.
    SUMS = ("said_true", "said_false", "part_true", "part_all_false", "part_silent")

    def __init__(self, sources: int, rounds: int = 300, prior: float = 0.5, settled: float = 1e-7) -> None:
        self.rounds, self.prior, self.settled = rounds, prior, settled
        self.sensitivity, self.specificity = np.full(sources, 0.8), np.full(sources, 0.9)
        self.first = True

    def probability(self, states: tuple[np.ndarray, np.ndarray], part: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """Probability that each pattern's value is true; ``states`` and ``part`` are (pattern, source) of the ones of two 0/1 tables."""
        by_pattern = lambda at, x: np.bincount(at[0], x[at[1]], n)
        if self.first:
            ones = np.ones(len(self.sensitivity))
            return (by_pattern(states, ones) + 0.5) / (by_pattern(part, ones) + 1)
        true, false = self._unseen(part, n)
        stated, silent = np.log(self.sensitivity / (1 - self.specificity)), np.log((1 - self.sensitivity) / self.specificity)
        odds = np.log(self.prior / (1 - self.prior)) + by_pattern(states, stated - silent) + by_pattern(part, silent) + np.log((1 - false) / (1 - true))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def _unseen(self, part, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Probability that no source that takes part states a value, if it is true and if it is false."""
        product = lambda x: np.minimum(np.exp(np.bincount(part[0], np.log(x)[part[1]], n)), 0.95)
        return product(1 - self.sensitivity), product(self.specificity)

    def sums(self, states, part, counts: np.ndarray) -> np.ndarray:
        """SUMS x sources, with the number of true and of all values as one more column."""
        n, k = len(counts), len(self.sensitivity)
        q = self.probability(states, part, n)
        true, false = self._unseen(part, n)
        w, v = counts * q, counts * (1 - q)
        by_source = lambda at, x: np.bincount(at[1], x[at[0]], k)
        all_false = v / (1 - false)
        rows = [by_source(states, w), by_source(states, v), by_source(part, w / (1 - true)), by_source(part, all_false), by_source(part, v + all_false * false)]
        out = np.zeros((len(self.SUMS), k + 1))
        out[:, :k] = rows
        out[0, k], out[1, k] = w.sum(), counts.sum()
        return out

    def step(self, total: np.ndarray) -> bool:
        """New qualities out of the sums over all patterns; whether they have settled."""
        said_true, said_false, part_true, part_all_false, part_silent = total[:, :-1]
        sensitivity = (said_true + 8) / (part_true + 10)
        specificity = (part_silent - said_false + 9) / (part_all_false + 10)
        prior = float(np.clip(total[0, -1] / max(total[1, -1], 1e-9), 0.01, 0.99))
        moved = max(np.abs(sensitivity - self.sensitivity).max(), np.abs(specificity - self.specificity).max(), abs(prior - self.prior))
        done = not self.first and moved < self.settled
        self.sensitivity, self.specificity, self.prior, self.first = sensitivity, specificity, prior, False
        return done

    def fit(self, states: np.ndarray, takes_part: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of each pattern after fitting; ``states`` and ``takes_part`` are patterns x sources of 0/1."""
        s, p = np.nonzero(states), np.nonzero(takes_part)
        for _ in range(self.rounds):
            if self.step(self.sums(s, p, counts)):
                break
        return self.probability(s, p, len(counts))


def _ones(lists, slots: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the entries of a column of lists."""
    return tuple(np.array([(i, slots[s]) for i, row in enumerate(lists) for s in row], np.int64).reshape(-1, 2).T)


def _field_batches(batch, slots):
    """(field, positions, states, part) of the rows of a batch of patterns."""
    fields = np.array(batch["field"].to_pylist(), object)
    for f in sorted(set(fields)):
        at = np.flatnonzero(fields == f)
        rows = batch.take(pa.array(at))
        yield f, at, _ones(rows["states"].to_pylist(), slots), _ones(rows["part"].to_pylist(), slots)


def _sum_task(models: dict[str, TwoSidedTruth], slots: dict[str, int]):
    """One row per field of the sums of a task's patterns."""

    def run(batches):
        total = {}
        for b in batches:
            counts = b["count"].to_numpy().astype(float)
            for f, at, states, part in (x for x in _field_batches(b, slots) if x[0] in models):
                total[f] = total.get(f, 0) + models[f].sums(states, part, counts[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.ravel() for x in total.values()], pa.list_(pa.float64()))], names=["field", "sums"])

    return run


def _probability_task(models: dict[str, TwoSidedTruth], slots: dict[str, int]):
    def run(batches):
        for b in batches:
            p = np.zeros(b.num_rows)
            for f, at, states, part in _field_batches(b, slots):
                p[at] = models[f].probability(states, part, len(at))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "count"), pa.array(p)], names=[*(c for c in b.schema.names if c != "count"), "probability"])

    return run


def fit_sources(patterns: DataFrame, rounds: int = 300, local: int = LOCAL_PATTERNS) -> tuple[dict[str, TwoSidedTruth], dict[str, int]]:
    """A fitted model for each field of ``patterns`` (``field, states, part, count``), and the slots of the sources.

    Every round adds up sums per source in the tasks that hold the patterns and sends only these to the driver. Up to
    ``local`` patterns are fetched once instead; the arithmetic is the same.
    """
    names = patterns.select(F.explode("part").alias("s")).distinct()
    if names.count() > SOURCES:
        raise ValueError(f"the qualities of at most {SOURCES:,} sources are kept on the driver")
    slots = {s: i for i, s in enumerate(sorted(r["s"] for r in names.collect()))}
    fields = [r["field"] for r in patterns.select("field").distinct().collect()]
    models = {f: TwoSidedTruth(len(slots)) for f in fields}
    held = patterns.toArrow().combine_chunks().to_batches() if patterns.count() <= local else None
    open_ = set(fields)
    for _ in range(rounds):
        current = {f: models[f] for f in open_}
        if held is not None:
            parts = [(f, np.array(x)) for b in _sum_task(current, slots)(held) for f, x in zip(b["field"].to_pylist(), b["sums"].to_pylist())]
        else:
            parts = [(r["field"], np.array(r["sums"])) for r in patterns.filter(F.col("field").isin(*open_)).mapInArrow(_sum_task(current, slots), "field string, sums array<double>").collect()]
        total: dict[str, np.ndarray] = {}
        for f, x in parts:
            total[f] = total.get(f, 0) + x.reshape(len(TwoSidedTruth.SUMS), -1)
        open_ -= {f for f in list(open_) if models[f].step(total[f])}
        if not open_:
            break
    return models, slots


def _claimed(c: str) -> Column:
    """The value that a field claims, as text; null or blank if none. Numbers as they are, a price only above 0; pictures as they are; other texts folded."""
    x = F.col(c).cast("string")
    if c == "price":
        return F.when(F.col(c) > 0, x)
    if c in ("area", "image"):
        return F.regexp_replace(x, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return fold_words(x)


def judge_values(dup_group: DataFrame, listing: DataFrame, cut: float = 0.5, local: int = LOCAL_PATTERNS) -> DataFrame:
    """``group_id, field, value, n_sources, probability, kept``: every claimed value of a group's fields with its probability."""
    m = listing.select("seq", "source", *JUDGED).join(_pairs(dup_group), "seq")
    source = F.coalesce("source", F.lit(""))
    claims = m.select("group_id", source.alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), _claimed(c).alias("value")) for c in JUDGED])).alias("c")).select("group_id", "source", "c.field", "c.value").filter("value != ''").distinct()
    claims = materialize(claims, "claims")
    sources = F.array_sort(F.collect_set("source"))
    stated = claims.groupBy("group_id", "field", "value").agg(sources.alias("states"), F.count(F.lit(1)).alias("n_sources"))
    part = claims.groupBy("group_id", "field").agg(sources.alias("part"))
    seen = materialize(stated.join(part, ["group_id", "field"]), "stated")
    patterns = materialize(seen.groupBy("field", "states", "part").count(), "patterns")
    models, slots = fit_sources(patterns, local=local)
    judged = seen.mapInArrow(_probability_task(models, slots), "group_id bigint, field string, value string, states array<string>, n_sources bigint, part array<string>, probability double")
    return judged.select("group_id", "field", "value", "n_sources", "probability", (F.col("probability") >= cut).alias("kept"))
