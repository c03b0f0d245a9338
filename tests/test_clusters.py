import random

import pytest

from plotwright.functions.photos import limbs_of_decimal
from plotwright.operators import clusters as C
from plotwright.operators.components import connected_components
from plotwright.operators.photo_join import photo_groups, photo_links
from tests.fixtures import as_set, listing

H1, H2, FAR = limbs_of_decimal(3), limbs_of_decimal(5), limbs_of_decimal(2**64 - 1)
BASE = {"type": "house", "area": 120.0, "rooms": 5, "source": "otodom", "source_id": "1", "price": 900_000, "locality": "A", "created": "2024-01-01"}


def groups(df):
    out = {}
    for r in df.select("cluster", "seq").collect():
        out.setdefault(r["cluster"], set()).add(r["seq"])
    return sorted(map(sorted, out.values()))


def clusters(spark, *records):
    return groups(C.assign_clusters(listing(spark, *({"source_id": str(i), **BASE, **r, "url": f"u{i}"} for i, r in enumerate(records)))))


def test_price_rules(spark):
    assert clusters(spark, {}, {"source": "gratka", "price": 900_400}) == [[1, 2]]
    assert clusters(spark, {"price": 800_000}, {"source": "olx", "price": 1_800_000}) == [[1], [2]]
    assert clusters(spark, {"price": 100}, {"source": "olx", "price": 115}) == [[1], [2]]  # 100 * 1.15 is below 115 in doubles
    assert clusters(spark, {"area": None}, {"source": "olx", "area": None}) == [[1], [2]]
    assert clusters(spark, {"rooms": 4}, {"source": "olx"}) == [[1, 2]]
    assert clusters(spark, {"type": "flat", "rooms": 4}, {"type": "flat", "source": "olx"}) == [[1], [2]]
    assert clusters(spark, {"price": None}, {"source": "olx", "price": 100}, {"source": "gratka", "price": 500}) == [[1, 2], [3]]


def test_photo_rules(spark):
    assert clusters(spark, {"phashes": [H1], "price": 100}, {"source": "olx", "phashes": [H2], "price": 900}) == [[1, 2]]
    assert clusters(spark, {"phashes": [H1]}, {"source": "olx", "phashes": [FAR]}) == [[1], [2]]
    assert clusters(spark, {}, {"source": "olx"}, {"source": "gratka", "phashes": [H1]}) == [[1], [2], [3]]
    chain = [limbs_of_decimal(0), limbs_of_decimal(2**30 - 1), limbs_of_decimal(2**60 - 1)]
    assert clusters(spark, *({"source": s, "phashes": [h]} for s, h in zip("abc", chain))) == [[1, 2, 3]]


def test_developers_have_a_card_per_price(spark):
    dev = [{"phashes": [H1], "title": "Nowe osiedle", "price": p} for p in (1, 1, 2, None)]
    assert clusters(spark, *dev) == [[1, 2], [3], [4]]
    assert clusters(spark, *({"source": "olx", "source_id": str(i), "price": p} for i, p in enumerate((100, 900, 900)))) == [[1], [2, 3]]


def test_sizes_unified_across_photos(spark):
    df = listing(spark, BASE | {"area": 204.0, "phashes": [H1], "image": "i"}, BASE | {"area": 280.0, "source": "olx", "phashes": [H2]}, BASE | {"area": 280.0, "source": "olx", "phashes": [FAR]}, BASE | {"area": 10.0, "locality": "B", "phashes": [H1]})
    assert as_set(C.unify_sizes(df).select("seq", "area")) == {(1, 204.0), (2, 204.0), (3, 280.0), (4, 10.0)}


def test_cards(spark):
    df = listing(spark, BASE | {"url": "b", "source": "gratka", "price": 900_400, "plot_area": 700.0, "created": "2024-02-01", "title": ""}, BASE | {"url": "a", "title": "t", "image": "i", "price_per_m2": 7.0}, BASE | {"url": "a", "title": "u", "source": "olx", "price": None})
    c = C.build_cards(df.selectExpr("*", "'k' as cluster", "false as developer")).first()
    assert (c.price, c.price_max, c.title, c.plot_area, c.created, c.source, c.url, c.price_per_m2) == (900_000, 900_400, "t", 700.0, "2024-02-01", "otodom", "a", 7.0)
    assert [(o.url, o.price) for o in c.offers] == [("a", 900_000), ("b", 900_400)] and c.sources == ["otodom", "gratka", "olx"] and c.cheapest.url == "a"


def test_same_size_links(spark):
    card = {"type": "flat", "area": 50.0, "rooms": 2, "street": "S"}
    df = listing(spark, *({**card, "url": u, "price": p} for u, p in (("a", 3), ("b", 2), ("a", 1))), card | {"url": "c", "rooms": 3}).selectExpr("*", "false as development")
    got = {r["seq"]: (r["prev_price"], len(r["also_listed"])) for r in C.link_same_size(df).collect()}
    assert got == {1: (2, 1), 2: (1, 2), 3: (2, 1)}


def test_components_and_splits_on_random_input(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    for small in (0, 10**6):  # by rounds, in one task
        assert as_set(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), small=small)) == {(x, find(x)) for x in list(parent)}
    rows = [(i, rng.choice("xyz"), rng.choice([None, *[float(rng.randrange(100, 400)) for _ in range(6)]])) for i in range(200)]
    got = {r["i"]: r["part"] for r in C.split_by_price(spark.createDataFrame(rows, "i int, k string, p double"), ["k"], "p").collect()}
    for k in "xyz":
        start, part = None, -1
        for i, _, p in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0)):
            if p is None:
                assert got[i] == 0
                continue
            if start is None or p > start * 1.15:
                start, part = p, part + 1
            assert got[i] == part


def test_empty(spark):
    assert C.dedupe(listing(spark)).count() == 0


def photos(rng, n):
    """Galleries of few different pictures with few bits changed, some broken."""
    base = [[rng.getrandbits(63) for _ in range(4)] for _ in range(6)]
    flip = lambda h, k: [x ^ sum(1 << b for b in rng.sample(range(63), k)) for x in h]
    return [rng.choice([None, [], [[1, 2]], [None], *[[flip(rng.choice(base), rng.choice([0, 5, 10, 11])) for _ in range(rng.randrange(1, 3))] for _ in range(6)]]) for _ in range(n)]


def same(a, b):
    whole = lambda g: [h for h in g or () if h and len(h) == 4]
    return any(sum((x ^ y).bit_count() for x, y in zip(g, h)) <= 40 for g in whole(a) for h in whole(b))


@pytest.mark.parametrize("block", [2000, 3])
def test_photo_joins_find_every_pair(spark, block):
    rng = random.Random(8)
    left = [(i, rng.choice("ab"), g) for i, g in enumerate(photos(rng, 60))]
    right = [(i, rng.choice("abc"), g) for i, g in enumerate(photos(random.Random(9), 40))] + [(99 + i, b, g) for i, b, g in left[:10]]
    schema = "id bigint, block string, hashes array<array<bigint>>"
    x, y = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    own = photo_links(x, None, 40, block)
    want = {(a[0], b[0]) for a in left for b in left if a[0] < b[0] and a[1] == b[1] and same(a[2], b[2])}
    assert as_set(own) == want and own.count() == len(want) and want
    met = photo_links(x, y, 40, block)
    between = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and same(a[2], b[2])}
    assert as_set(met) == between and met.count() == len(between)
    assert as_set(photo_groups(x, 40, block)) == as_set(connected_components(own))


def test_equal_galleries_are_one_class(spark):
    g, h = [[1, 2, 3, 4]], [[1, 2, 3, 5]]
    df = listing(spark, *[{"type": "flat", "phashes": g}] * 40, {"type": "flat", "phashes": h}, {"type": "house", "phashes": g}, {"type": "flat", "phashes": [[1]]}, {"type": "flat", "phashes": [[1]]})
    assert C.photo_pairs(df, ["type"]).count() == 41 * 40 // 2
    assert as_set(C.photo_components(df, ["type"]).filter("v <= 42")) == {(k, 1) for k in range(1, 42)}


def test_blocks_of_several_keys_are_not_confused(spark):
    g = [[1, 2, 3, 4]]
    df = listing(spark, *({"agency": a, "market": b, "phashes": g} for a, b in (("a/", "b"), ("a", "/b"), ("a", None), ("a", "-"), (None, None), (None, None), ("a/", "b"))))
    assert as_set(C.photo_pairs(df, ["agency", "market"])) == {(1, 7), (5, 6)}


def test_sizes_are_unified_by_area_only(spark):
    row = {"type": "flat", "locality": "T", "price": 5, "phashes": [[1, 2, 3, 4]]}
    df = listing(spark, row | {"area": 50.0, "rooms": 2, "source": "gratka"}, row | {"area": 50.0, "rooms": 3, "source": "otodom"}, row | {"area": 60.0, "rooms": 3, "price": 6}, row | {"area": 70.0, "rooms": 4, "price": 6, "source": "otodom"})
    assert as_set(C.unify_sizes(df).select("seq", "area", "rooms")) == {(1, 50.0, 2), (2, 50.0, 3), (3, 70.0, 4), (4, 70.0, 4)}
