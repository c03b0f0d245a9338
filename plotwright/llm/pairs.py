"""Pairs of classes turned into pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_pairs(near: DataFrame, twins: DataFrame) -> DataFrame:
    """``seq_a, seq_b`` (seq_a < seq_b): all pairs of rows of linked classes, and of rows of one class.

    ``near``: ``a, b``, ids of linked classes, each pair once; a class of one row has the row's
    seq as its id. ``twins``: ``id, seq`` for the rows of classes with several rows.
    """
    across = _expand(_expand(near, twins, "a"), twins, "b").select(F.least("a", "b").alias("seq_a"), F.greatest("a", "b").alias("seq_b"))
    x, y = twins.alias("x"), twins.alias("y")
    within = x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.seq") < F.col("y.seq"))).select(F.col("x.seq").alias("seq_a"), F.col("y.seq").alias("seq_b"))
    return across.unionByName(within)


def _expand(pairs: DataFrame, twins: DataFrame, side: str) -> DataFrame:
    t = twins.select(F.col("id").alias(side), F.col("seq").alias("__seq"))
    return pairs.join(t, side, "left").withColumn(side, F.coalesce("__seq", side)).drop("__seq")


def class_rows(links: DataFrame, members: DataFrame) -> DataFrame:
    """``seq, class_id, n_links``: every row that has a partner, with the class of equal rows it is in and the number of other classes that this one is linked to.

    The arguments are those of :func:`expand_pairs`; nothing is multiplied, so a class may hold a third of all rows.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    several = members.select("id", "seq").join(ends, "id", "left")
    single = ends.join(members.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("seq"), "n_links")
    return several.unionByName(single).select("seq", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
