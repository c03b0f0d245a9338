"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
#: Below this many rows no key is worth a path of its own.
HOT_MIN_ROWS = 200_000


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, keep: list[str]) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key.

    ``right[weight]`` is the number of rows that ``left`` has of the key. Keys with more
    than ``HOT_SHARE`` of all rows number at most ``1 / HOT_SHARE`` whatever the data, so
    their slice of ``right`` is broadcast; all other keys take a shuffle join. No row is
    dropped: the two branches are disjoint by construction.
    """
    total = right.agg(F.sum(weight).alias("n"), F.max(weight).alias("m")).first()
    n, biggest = total["n"] or 0, total["m"] or 0
    cut = max(HOT_MIN_ROWS, n * HOT_SHARE)
    slim = right.select(*keys, *keep)
    if biggest <= cut:
        return left.join(slim, keys)
    hot = F.broadcast(right.filter(F.col(weight) > cut).select(*keys, *keep))
    return left.join(hot, keys).unionByName(
        left.join(hot, keys, "left_anti").join(right.filter(F.col(weight) <= cut).select(*keys, *keep), keys)
    )
