"""Pairwise matches consolidated into groups: hash-to-min over a relation of edges.

Every vertex v keeps a cluster C(v), at first itself and its neighbours. In each round v
sends C(v) to the smallest member m of C(v), and m to all other members; the received sets
form the next clusters. The process ends when the clusters are stars: the smallest vertex of
a component holds the component, every other vertex holds only that smallest vertex.

Clusters are kept as rows (v, u), never as collected sets, so that a component with a third
of all vertices is spread over all tasks. Each round is written to the shared folder. When at most
``LAST_ROWS`` rows are left, the remaining rounds run in one task, on arrays: a job per round would cost more than its rows.

Defined results
---------------
* null endpoints: the edge is ignored; loops make their vertex a component of one.
* repeated and reversed edges count once; an empty edge table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import BLANKS
from plotwright.operators.skew import lookup_join
from plotwright.session import discard, materialize, materialize_with, ship_code

#: Rows of clusters that one task finishes.
LAST_ROWS = 200_000


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200, last_rows: int = LAST_ROWS) -> DataFrame:
    """``v, comp``: each vertex of ``edges`` with the smallest vertex it is linked to.

    ``a`` and ``b`` are columns of one orderable type. Components that have become stars leave
    the iteration, so later rounds touch only long chains. ``max_rounds`` only guards against a
    defect; reaching it raises, it never returns a partial result.
    """
    pairs = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).filter(F.col("v").isNotNull() & F.col("u").isNotNull())
    both = pairs.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e"))
    clusters, left = materialize_with(both.select("e.v", "e.u").distinct(), "h2m", n=F.count(F.lit(1)))
    settled = []
    for done in range(max_rounds):
        if left["n"] <= last_rows or not left["n"]:
            return reduce(DataFrame.unionByName, [*settled, _finish(clusters)])
        degree = F.count_if(F.col("u") != F.col("v"))
        # Tables are written so that the joins meet plain exchanges, which adaptive execution can split where a key is hot.
        smallest = materialize(clusters.groupBy("v").agg(F.min("u").alias("m"), degree.alias("deg")).select("v", F.least("v", "m").alias("comp"), "deg"), "h2m-min")
        active = smallest.select("v", "comp")
        if done < 3 or done % 2:  # most components are stars after few rounds; later it pays to look every other time
            flagged = _flag_stars(smallest)
            settled.append(flagged.filter("star").select("v", "comp"))
            active = flagged.filter(~F.col("star")).select("v", "comp")
        sent = clusters.join(active, "v").select(F.explode(_messages()).alias("e")).select("e.v", "e.u").filter(F.col("v") != F.col("u"))
        following, left = materialize_with(sent.distinct(), "h2m", n=F.count(F.lit(1)))
        discard(clusters)
        discard(smallest)
        clusters = following
    raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")


def _finish(clusters: DataFrame) -> DataFrame:
    """``v, comp`` of a small table of clusters: the same rounds in one task."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        names = pc.unique(pa.chunked_array([*t["v"].chunks, *t["u"].chunks]))
        names = names.take(pc.sort_indices(names))
        n = len(names)
        v, u = (pc.index_in(t[c], names).to_numpy().astype(np.int64) for c in ("v", "u"))
        rows = np.unique(v * n + u)
        while True:
            v, u = rows // n, rows % n
            m = np.arange(n)
            np.minimum.at(m, v, u)
            m, x = m[v], np.where(m[v] == v, u, v)
            sent = np.concatenate([m * n + u, u * n + m, m * n + x, x * n + m])
            following = np.unique(sent[sent // n != sent % n])
            if len(following) == len(rows) and (following == rows).all():
                break
            rows = following
        comp = np.arange(n)
        np.minimum.at(comp, rows // n, rows % n)
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(comp))], names=["v", "comp"])

    ship_code(clusters.sparkSession)
    kind = clusters.schema["v"].dataType.simpleString()
    return clusters.repartition(1).mapInArrow(run, f"v {kind}, comp {kind}")


def _flag_stars(smallest: DataFrame) -> DataFrame:
    """``v, comp, star``: whether the vertex is in a component that is a finished star.

    By symmetry all leaves of a centre are in its cluster; if they are all of it, the component is one.
    """
    leaves = smallest.filter((F.col("v") != F.col("comp")) & (F.col("deg") == 1)).groupBy("comp").agg(F.count(F.lit(1)).alias("deg"))
    centres = smallest.filter(F.col("v") == F.col("comp")).select("comp", "deg")
    stars = materialize(centres.join(leaves.unionByName(centres.filter("deg = 0")), ["comp", "deg"], "left_semi").select("comp", F.lit(True).alias("star")), "h2m-stars")
    flagged = materialize(smallest.join(stars, "comp", "left").select("v", "comp", F.coalesce("star", F.lit(False)).alias("star")), "h2m-flag")
    discard(stars)
    return flagged


def _messages() -> Column:
    """What row (v, u) of a cluster with smallest member comp contributes to the next round."""
    v, u, m = F.col("v"), F.col("u"), F.col("comp")
    pair = lambda x, y: F.struct(x.alias("v"), y.alias("u"))
    ends = F.array(pair(m, u), pair(u, m))
    return F.when(v == m, ends).otherwise(F.concat(ends, F.array(pair(m, v), pair(v, m))))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tidy_url(url: Column) -> Column:
    """An address without what differs between copies: scheme, www, host case, query, fragment, closing slashes, blanks."""
    shape = r"^(?:[a-zA-Z]+:)?(?://)?([^/?#]*)([^?#]*?)/*(?:[?#].*)?$"

    def parts(u: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(u, shape, 1)), r"^www\.", "")
        return _bind(F.concat(host, F.regexp_extract(u, shape, 2)), lambda x: F.when(x != "", x))

    return _bind(F.regexp_replace(url, f"[{BLANKS}]+", ""), parts)


def _tidy_id(x: Column) -> Column:
    return _bind(F.lower(F.regexp_replace(x, f"[{BLANKS}]+", "")), lambda t: F.when(t != "", t))


def _key(name: Column) -> Column:
    """A name as 16 bytes, null for null."""
    return F.unhex(F.md5(name))


def _id_key(source: Column, source_id: Column) -> Column:
    return _key(F.concat(F.lit("i|"), _tidy_id(source), F.lit("|"), _tidy_id(source_id)))


def _url_key(url: Column) -> Column:
    return _key(F.concat(F.lit("u|"), tidy_url(url)))


def ad_groups(listing: DataFrame, match_pair: DataFrame) -> DataFrame:
    """``source, source_id, group_seq`` of every ad that confirmed matches link to another ad.

    ``match_pair`` names each side by source and source_id, by url, or by both (then the two
    names are linked as well). Sides that no row of ``listing`` knows still carry links.
    Ads without source or source_id cannot be named and have no row; sides without any name
    and undecided rows (``is_match`` null) link nothing.
    """
    named = listing.select("seq", "source", "source_id", _id_key(F.col("source"), F.col("source_id")).alias("id"), "url").filter(F.col("id").isNotNull())
    ads = named.groupBy("source", "source_id").agg(F.min("seq").alias("ad"), F.min("id").alias("id"))
    by_url = named.filter(F.col("url").isNotNull()).select(_url_key(F.col("url")).alias("name"), "id").groupBy("name").agg(F.min("id").alias("id"))

    def side(s: str) -> Column:
        return F.array_compact(F.array(_id_key(F.col(f"{s}_source"), F.col(f"{s}_source_id")), _url_key(F.col(f"{s}_url"))))

    names = match_pair.filter(F.col("is_match")).select(F.concat(side("left"), side("right")).alias("names"))
    # Names of one pair form a star around the first; a url that a listed ad has stands for the ad's id.
    links = materialize(names.filter(F.size("names") > 1).select(F.get("names", F.lit(0)).alias("x"), F.explode(F.slice("names", 2, 3)).alias("y")).filter("x != y").distinct(), "links")
    used = links.select(F.explode(F.array("x", "y")).alias("name")).distinct()
    # Listed ads are even numbers (twice their first seq), unlisted names odd ones; written once, so the numbers stay.
    ad_of = ads.groupBy("id").agg(F.min("ad").alias("ad"))
    known = used.join(by_url, "name", "left").select("name", F.coalesce("id", "name").alias("id")).join(ad_of, "id", "left")
    numbers = materialize(known.select("name", F.when(F.col("ad").isNotNull(), F.col("ad") * 2).otherwise(F.monotonically_increasing_id() * 2 + 1).alias("v")), "names")
    edges = links.join(numbers.select(F.col("name").alias("x"), F.col("v").alias("a")), "x").join(numbers.select(F.col("name").alias("y"), F.col("v").alias("b")), "y").select("a", "b")
    comps = hash_to_min(edges)
    listed = comps.filter(F.pmod("v", F.lit(2)) == 0).select("comp", F.expr("v div 2").alias("ad"))
    sizes = materialize(listed.groupBy("comp").agg(F.min("ad").alias("group_seq"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    grouped = lookup_join(listed, sizes, ["comp"], "n", ["group_seq"])
    return ads.join(grouped, "ad").select("source", "source_id", "group_seq")
