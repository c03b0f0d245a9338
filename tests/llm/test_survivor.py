import numpy as np

from plotwright.llm.survivor import TwoSidedTruth, judge_values, survivors
from tests.fixtures import as_set, listing, rows

T = 1_704_700_000


def group(spark, *pairs):
    return rows(spark, "group_id bigint, seq bigint", *({"group_id": g, "seq": s} for g, s in pairs))


def trust(spark):
    return rows(spark, "source string, rank int", {"source": "a", "rank": 1}, {"source": "b", "rank": 2})


def test_survivor_fields(spark):
    ads = listing(
        spark,
        {"source": "b", "title": "t", "rooms": 2, "price": 10, "created": str(T + 5)},
        {"source": "a", "title": "t", "rooms": 2, "price": 0, "created": str(T + 9)},
        {"source": "z", "title": "t", "rooms": 2, "street": "s", "agency": " ", "price": 30, "created": "brak"},
        {"source": "z", "title": "t", "rooms": 2, "price": 40, "created": None},
        {"source": None, "title": None, "price": None},
        {"source": "a", "title": "x" * 50_000, "price": 7, "created": str(T)},
        {"source": "a", "title": "t", "price": 8, "created": str(T)},
    )
    groups = group(spark, (1, 1), (1, 2), (1, 2), (1, 3), (1, 99), (2, 4), (2, 3), (3, 5), (4, 99), (5, 6), (5, 7), (None, 1), (6, None))
    ms = lambda s: s * 1000
    assert as_set(survivors(groups, ads, trust(spark))) == {
        (1, 3, 10, "a", ms(T + 9)),
        (2, 3, 30, "z", None),
        (3, 5, None, None, None),
        (5, 6, 7, "a", ms(T)),
    }


def test_ties(spark):
    ads = listing(spark, {"source": "b", "title": "t", "created": str(T + 1)}, {"source": "a", "title": "t", "created": str(T)}, {"source": "a", "title": "t", "created": str(T + 1)}, {"source": "a", "title": "t", "created": str(T + 1)})
    assert as_set(survivors(group(spark, (1, 1), (1, 2), (1, 3), (1, 4)), ads, trust(spark)).select("seq")) == {(3,)}


def test_empty(spark):
    assert survivors(group(spark), listing(spark), trust(spark)).count() == 0
    assert judge_values(group(spark), listing(spark)).count() == 0


def test_two_sided_quality_is_learned():
    rng = np.random.default_rng(3)
    sens, spec = np.array([0.9, 0.8, 0.6]), np.array([0.95, 0.7, 0.9])
    true = rng.random(30_000) < 0.4
    states = np.where(true[:, None], rng.random((30_000, 3)) < sens, rng.random((30_000, 3)) >= spec).astype(float)
    seen = states.any(1)
    patterns, at, counts = np.unique(states[seen], axis=0, return_inverse=True, return_counts=True)
    p = TwoSidedTruth(3).fit(patterns, np.ones_like(patterns), counts.astype(float))
    odds = np.log(0.4 / 0.6) + patterns @ np.log(sens / (1 - spec)) + (1 - patterns) @ np.log((1 - sens) / spec)
    right = lambda keep: (keep[at] == true[seen]).mean()
    assert right(p >= 0.5) > right(odds >= 0) - 0.03  # as good as with the true qualities


def test_several_values_may_be_true(spark):
    ads = listing(spark, *({"source": s, "agency": v} for _ in range(6) for s, v in (("a", "X"), ("a", "Y"), ("b", "X"), ("b", "y "), ("c", "X"), ("c", "Q"))))
    groups = group(spark, *((g, g * 6 + i + 1) for g in range(6) for i in range(6)))
    got = {(r["group_id"], r["value"]): r["kept"] for r in judge_values(groups, ads).collect()}
    assert all(got[g, "x"] and got[g, "y"] for g in range(6)) and len(got) == 18


def test_prices_areas_titles_and_pictures_are_judged(spark):
    one = {"area": 50.5, "title": "Dom, ogród", "image": "http://x/A.jpg"}
    ads = listing(spark, *(one | {"source": s, "price": p, **more} for s, p, more in (("a", 100, {}), ("b", 100, {"title": "DOM OGROD"}), ("c", 0, {"image": "http://x/a.jpg"}), ("d", None, {"image": " ", "area": None}), ("e", 120, {}))))
    got = {(r["field"], r["value"]): r["n_sources"] for r in judge_values(group(spark, *((1, k) for k in range(1, 6))), ads).collect()}
    assert got == {("price", "100"): 2, ("price", "120"): 1, ("area", "50.5"): 4, ("title", "dom ogrod"): 5, ("image", "http://x/A.jpg"): 3, ("image", "http://x/a.jpg"): 1}


def test_every_source_has_its_own_quality(spark):
    # Sixteen sources; those from the thirteenth on claim least, and two of them that agree are two votes.
    large = [("s%02d" % k, v) for k in range(13) for v in ("x", "y")]
    small = [("s13", "pair"), ("s14", "pair"), ("s15", "single")]
    ads = listing(spark, *({"source": s, "agency": v} for _ in range(10) for s, v in large + small))
    n = len(large + small)
    groups = group(spark, *((2 * g + (i >= len(large)), g * n + i + 1) for g in range(10) for i in range(n)))
    p = {r["value"]: r["probability"] for r in judge_values(groups, ads).filter("group_id in (4, 5)").collect()}
    assert p["x"] > 0.9 and p["pair"] > p["single"], p


def test_planted_sources_are_told_apart_and_parts_give_the_same_answer(spark):
    # Four sources that state a group's true agency nine, eight, seven and five times of ten, else another.
    rng = np.random.default_rng(11)
    honest = {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.5}
    ads, members = [], []
    for g in range(150):
        for s, share in honest.items():
            ads.append({"source": s, "agency": f"True {g}" if rng.random() < share else f"Wrong {rng.integers(3)}"})
            members.append((g, len(ads)))
    df, groups = listing(spark, *ads), group(spark, *members)
    whole = {(r["group_id"], r["value"]): r["probability"] for r in judge_values(groups, df).filter("field = 'agency'").collect()}
    parts = {(r["group_id"], r["value"]): r["probability"] for r in judge_values(groups, df, local=0).filter("field = 'agency'").collect()}
    assert whole.keys() == parts.keys() and max(abs(whole[k] - parts[k]) for k in whole) < 1e-6
    best = {g: max((k for k in whole if k[0] == g), key=lambda k: (whole[k], k[1]))[1] for g in range(150)}
    votes = {g: {} for g in range(150)}
    for (g, i), ad in zip(members, ads):
        votes[g][ad["agency"]] = votes[g].get(ad["agency"], 0) + 1
    # A majority that is not alone is right in half of the cases.
    top = {g: [x for x, n in v.items() if n == max(v.values())] for g, v in votes.items()}
    majority = sum(f"True {g}" in t for g, t in top.items() if len(t) == 1) + sum(f"True {g}" in t for g, t in top.items() if len(t) > 1) / 2
    right = sum(best[g] == f"true {g}" for g in best)
    assert right >= majority and right > 135, (right, majority)
