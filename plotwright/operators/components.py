"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.session import discard, materialize, materialize_with, ship_code

#: Edges that one task joins up; more go through rounds.
SMALL = 200_000


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the smallest one it is linked to, directly or not."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        for at in (a, b, low[a], low[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        batches = list(batches)
        if batches:
            t = pa.Table.from_batches(batches)
            names, codes = np.unique(np.concatenate([t["v"].to_numpy(), t["u"].to_numpy()]), return_inverse=True)
            low = smallest_linked(len(names), codes[: t.num_rows], codes[t.num_rows :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[low])], names=["v", "comp"])

    ship_code(edges.sparkSession)
    return edges.repartition(1).mapInArrow(run, "v bigint, comp bigint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, small: int = SMALL) -> DataFrame:
    """``v, comp``: every vertex of ``edges`` with the smallest vertex of its component.

    Large-star links the larger neighbours of a vertex to its smallest, small-star the smaller ones; both
    are a minimum per vertex and one join, pre-aggregated and written, until no edge changes. Up to ``small`` edges
    are joined up in one task.
    """
    links, held = materialize_with(edges.select(F.col(a).cast("bigint").alias("v"), F.col(b).cast("bigint").alias("u")).filter("v is not null and u is not null"), "edges", n=F.count(F.lit(1)))
    if held["n"] <= small:
        return _in_one_task(links)
    vertices = materialize(links.select(F.explode(F.array("v", "u")).alias("v")).distinct(), "vertices")
    mark = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("v", "u"))}
    now, before = materialize_with(links.filter("v != u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "stars", **mark)
    for _ in range(max_rounds):
        both = now.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e")).select("e.v", "e.u")
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = materialize(both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v != u").distinct(), "stars")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        following, after = materialize_with(small.select("e.v", "e.u").filter("v != u").distinct(), "stars", **mark)
        discard(large)
        discard(now)
        now = following
        if after == before:
            return vertices.join(now, "v", "left").select("v", F.coalesce("u", "v").alias("comp"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
