"""Joins on "some photo in common": galleries of perceptual hashes compared inside blocks.

A block is a key (a size, a town and price) inside which galleries are compared. Blocks are dealt out to tasks many at
a time; a block of more than ``BLOCK`` galleries is cut into tiles whose pairs are separate tasks, so no
task holds more than two tiles of a block and work outside crowded blocks grows with the number of rows.
Distances are exact: every pair of a block is compared, in arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.operators.components import connected_components, smallest_linked
from plotwright.session import ship_code

#: Galleries of one tile.
BLOCK = 2_000
#: Rows that one task gets, on average.
TASK_ROWS = 50_000
LIMBS = 4


def galleries_met(hashes: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) galleries that share a photo: ``hashes`` (photos x limbs) with the gallery of each; ``left``, ``right`` mark the galleries of the sides."""
    a, b = np.flatnonzero(left[owner]), np.flatnonzero(right[owner])
    found = []
    step = max(1, 4_000_000 // max(len(b), 1))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        bits = np.zeros((len(part), len(b)), np.uint16)
        for k in range(hashes.shape[1]):
            bits += np.bitwise_count(hashes[part, k][:, None] ^ hashes[b, k][None, :])
        i, j = np.nonzero(bits <= threshold)
        found.append(np.unique(np.stack([owner[part[i]], owner[b[j]]], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(photos x limbs, gallery of each photo) of a column of galleries; hashes of other than ``LIMBS`` limbs or with nulls are no photos."""
    photos, owner = [], []
    for i, gallery in enumerate(column.to_pylist()):
        for h in gallery or ():
            if h is not None and len(h) == LIMBS and None not in h:
                photos.append(h)
                owner.append(i)
    return np.array(photos, np.int64).reshape(-1, LIMBS).view(np.uint64), np.array(owner, np.int64)


def _tile_task(threshold: int, stars: bool):
    """Pairs (a, b) of the tiles in a task; sides are 0, 1, or 2 for rows that are on both (a < b then).

    With ``stars`` a tile of one part gives, instead of all its pairs, each linked gallery b with the smallest a it is linked to.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tile", "ascending"), ("check", "ascending"), ("id", "ascending")])
        tile, check, side, ids = (t[c].to_numpy() for c in ("tile", "check", "side", "id"))
        hashes, owner = _flat(t["hashes"])
        out_a, out_b = [], []
        bounds = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (check[1:] != check[:-1]), True])
        photo_at = np.searchsorted(owner, bounds)
        for k in range(len(bounds) - 1):
            lo, hi = bounds[k], bounds[k + 1]
            own = side[lo:hi]
            if hi - lo < 2 or not ((own != 1).any() and (own != 0).any()):
                continue
            p, q = photo_at[k], photo_at[k + 1]
            i, j = galleries_met(hashes[p:q], owner[p:q] - lo, own != 1, own != 0, threshold)
            if (own == 2).all():
                if stars:  # rows are in the order of their ids
                    low = smallest_linked(hi - lo, i, j)
                    j = np.flatnonzero(low < np.arange(hi - lo))
                    i = low[j]
                else:
                    i, j = i[i < j], j[i < j]
            out_a.append(ids[lo + i])
            out_b.append(ids[lo + j])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table([pa.array(join(out_a)), pa.array(join(out_b))], schema=schema)

    return run


def _usable(d: DataFrame) -> DataFrame:
    return d.filter(F.col("block").isNotNull() & (F.size("hashes") > 0)).select("id", "block", "hashes")


def _parts(d: DataFrame, n: str, parts: str, block: int) -> DataFrame:
    return d.groupBy("block").agg(F.count(F.lit(1)).alias(n)).withColumn(parts, F.ceil(F.col(n) / block))


def _run(rows: DataFrame, total: int, threshold: int, stars: bool) -> DataFrame:
    cores = rows.sparkSession.sparkContext.defaultParallelism
    buckets = max(cores, -(-(total or 0) // TASK_ROWS))
    return rows.groupBy(F.pmod(F.col("tile"), F.lit(buckets))).applyInArrow(_tile_task(threshold, stars), "a bigint, b bigint")


def _tile(*what) -> list[Column]:
    """Names of tiles: two independent 64-bit digests."""
    return [F.xxhash64(*what).alias("tile"), F.xxhash64(*reversed(what)).alias("check")]


def _own_tiles(galleries: DataFrame, block: int) -> tuple[DataFrame, int, int]:
    """(rows of the tiles of a self-join, their number, parts of the most crowded block)."""
    met = _parts(galleries, "n", "parts", block).filter("n > 1")
    sent = galleries.join(met, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    # A row is on both sides of the tile of its own part, else on the side of the smaller part or the larger.
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    most = met.agg(F.sum(F.col("n") * F.col("parts")).alias("n"), F.max("parts").alias("p")).first()
    return sent.select("id", "hashes", *_tile("block", F.least("own", "other"), F.greatest("own", "other")), side.cast("int").alias("side"), (F.col("parts") > 1).alias("cut")), most["n"] or 0, most["p"] or 0


def photo_links(left: DataFrame, right: DataFrame | None, threshold: int, block: int = BLOCK) -> DataFrame:
    """``a, b``: galleries (``id, block, hashes``) of ``left`` and ``right`` in one block with two photos at most ``threshold`` bits apart; of ``left`` itself, a < b, without ``right``.

    Null blocks equal nothing; galleries without photos meet nothing. Ids are unique within a side.
    """
    ship_code(left.sparkSession)
    if right is None:
        rows, total, _ = _own_tiles(_usable(left), block)
        return _run(rows.drop("cut"), total, threshold, False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left, right = _usable(left), _usable(right)
    met = _parts(left, "n", "p", block).join(_parts(right, "m", "q", block), "block")

    def tiles(d: DataFrame, own: str, other: str, side: int) -> DataFrame:
        placed = d.join(met, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        return placed.select("id", "hashes", *_tile("block", *(("own", "other") if side == 0 else ("other", "own"))), F.lit(side).alias("side"))

    total = met.agg(F.sum(F.col("n") * F.col("q") + F.col("m") * F.col("p"))).first()[0]
    return _run(tiles(left, "p", "q", 0).unionByName(tiles(right, "q", "p", 1)), total, threshold, False)


def photo_groups(galleries: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """``v, comp``: galleries that are linked to another, directly or not, with the smallest id of their group.

    A block of one tile is settled in its task; only crowded blocks go through iterated components.
    """
    ship_code(galleries.sparkSession)
    rows, total, parts = _own_tiles(_usable(galleries), block)
    settled = _run(rows.filter("not cut").drop("cut"), total, threshold, True).select(F.explode(F.array(F.struct(F.col("b").alias("v"), F.col("a").alias("comp")), F.struct(F.col("a").alias("v"), F.col("a").alias("comp")))).alias("e")).select("e.*").distinct()
    if parts <= 1:
        return settled
    return settled.unionByName(connected_components(_run(rows.filter("cut").drop("cut"), total, threshold, True)))
