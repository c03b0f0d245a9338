import random

from plotwright.llm.components import ad_groups, hash_to_min, tidy_url
from tests.fixtures import MATCH_PAIR, as_set, listing, rows


def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in list(parent)}


def test_chain_star_loops_and_repeats(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 540)]
    edges = chain + star + [(7, 7), (9, 8), (8, 9), (9, 8)]
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a bigint, b bigint")
    for last_rows in (0, 60, 10**6):  # rounds as jobs, both, in one task
        assert as_set(hash_to_min(df, last_rows=last_rows)) == closure(edges)


def test_names_of_any_orderable_type(spark):
    df = spark.createDataFrame([(b"b", b"a"), (b"c", b"b"), (b"x", b"y")], "a binary, b binary")
    for last_rows in (0, 100):
        assert {(bytes(r["v"]), bytes(r["comp"])) for r in hash_to_min(df, last_rows=last_rows).collect()} == {(b"a", b"a"), (b"b", b"a"), (b"c", b"a"), (b"x", b"x"), (b"y", b"x")}


def test_random_graphs(spark):
    rng = random.Random(5)
    edges = [(base + rng.randrange(40), base + rng.randrange(40)) for base in range(0, 1000, 50) for _ in range(rng.randrange(5, 45))]
    for last_rows in (0, 10**6):
        assert as_set(hash_to_min(spark.createDataFrame(edges, "a bigint, b bigint"), last_rows=last_rows)) == closure(edges)


def test_no_edges(spark):
    for last_rows in (-1, 10):
        assert hash_to_min(spark.createDataFrame([], "a bigint, b bigint"), last_rows=last_rows).count() == 0


def test_urls_differ_only_in_dress(spark):
    same = ["https://www.x.example/a/B-1", " http://x.example/a/B-1/", "HTTPS://WWW.X.EXAMPLE/a/B-1?page=2&from=q", "https://x.example/a/B-1#galeria", "//x.example/a/B-1"]
    df = spark.createDataFrame([(u,) for u in same + ["https://x.example/a/b-1", "", None, "  "]], "u string")
    got = [r[0] for r in df.select(tidy_url(df.u)).collect()]
    assert got == ["x.example/a/B-1"] * 5 + ["x.example/a/b-1", None, None, None]


def pair(l, r, m=True):
    side = lambda p, x: {f"{p}_source": x[0], f"{p}_source_id": x[1], f"{p}_url": x[2]}
    return {"pair_id": 1, **side("left", l), **side("right", r), "is_match": m}


def test_groups_of_ads(spark):
    ads = listing(
        spark,
        {"seq": 10, "source": "a", "source_id": "1", "url": "https://www.a.example/1"},
        {"seq": 4, "source": "a", "source_id": "1", "url": None},
        {"seq": 2, "source": "b", "source_id": "1", "url": "https://b.example/1"},
        {"seq": 3, "source": "b", "source_id": "2", "url": ""},
        {"seq": 5, "source": "c", "source_id": "7", "url": "https://c.example/7"},
        {"seq": 6, "source": "c", "source_id": "8", "url": "https://c.example/8"},
        {"seq": 1, "source": None, "source_id": "8", "url": "https://c.example/9"},
    )
    none = (None, None, None)
    matches = rows(
        spark, MATCH_PAIR,
        pair(("a", " 1", None), (None, None, "http://gone.example/x")),  # through an ad that is not listed
        pair((None, None, "https://GONE.example/x?y=1"), (None, None, "https://b.example/1#g")),
        pair(("b", "2", None), ("b", "2", None)),  # itself
        pair(("c", "7", None), ("c", "8", None), None),  # undecided
        pair(("c", "7", None), ("c", "8", None), False),
        pair(("c", "8", None), none), pair(none, none),
    )
    assert as_set(ad_groups(ads, matches)) == {("a", "1", 2), ("b", "1", 2)}
    assert ad_groups(ads, rows(spark, MATCH_PAIR)).count() == 0
    assert ad_groups(listing(spark), matches).count() == 0
