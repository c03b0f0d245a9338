import datetime as dt

import numpy as np

from plotwright.llm.linkage import LabelModel, link_deeds, street_in_title
from tests.fixtures import as_set, rows

ARCHIVE = "archive_id bigint, type string, area double, title string, image string, locality string, district string, rooms int, url string, source string, price bigint, first_seen date, delisted date, sold string"
DEED = "deed_id bigint, kind string, d date, c bigint, a double, izb int, kond int, grunt double, rynek string, msc string, ul string, nr string, dz string"
D = dt.date


def towns(spark):
    return rows(spark, "loc_id bigint, name string", {"loc_id": 1, "name": "Tłunybrowa"}, {"loc_id": 2, "name": "Prupatyń"})


def test_street_in_title():
    assert street_in_title("Mieszkanie przy ul. A. Nowaka - taras, sad") == "a nowaka"
    assert street_in_title("zieleń, stacja | Lokal | al. Lubosopa") == "lubosopa"
    assert street_in_title("Willa, dwustronne") == street_in_title(None) == street_in_title("") == ""


def test_label_model_recovers_accuracies_and_joins_copies():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    accuracy = (0.95, 0.85, 0.75)
    votes = np.stack([np.where(rng.random(len(y)) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in accuracy], 1)
    votes = np.concatenate([votes, votes[:, 2:]], 1)  # the last function only repeats the third
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = LabelModel(4).fit(patterns, counts)
    assert any(set(b) == {2, 3} for b in m.blocks)
    p = dict(zip(map(tuple, patterns), m.posterior(patterns)))
    truth = np.array([p[tuple(v)] for v in votes])
    assert ((truth > 0.5) == y).mean() > 0.95
    assert abs(m.prior[1] - 0.2) < 0.03


def test_rules(spark):
    base = {"type": "flat", "area": 50.0, "locality": "m. Tłunybrowa", "title": "Mieszkanie, ul. Nowochostkowa, taras", "rooms": 2, "price": 100_000, "delisted": D(2024, 6, 1)}
    arch = [base, base | {"title": None, "rooms": None, "price": None}, base | {"delisted": None}, base | {"area": None}, base | {"locality": None}, base | {"title": "x" * 20_000}, base]
    deed = {"kind": "flat", "d": D(2024, 7, 1), "c": 105_000, "a": 50.6, "izb": 2, "msc": "TŁUNYBROWA ", "ul": "NOWOCHOSTKOWA"}
    deeds = [deed, deed | {"ul": "Dworcowa"}, deed | {"izb": 3}, deed | {"a": 50.61}, deed | {"d": D(2024, 4, 2)}, deed | {"d": D(2024, 4, 1)}, deed | {"d": D(2025, 7, 6)}, deed | {"d": D(2025, 7, 7)},
             deed | {"c": 112_000}, deed | {"c": 112_001}, deed | {"kind": "house"}, deed | {"msc": "Prupatyń"}, deed | {"ul": "Nowohcostkowa"}, deed | {"ul": None, "izb": None}, deed | {"msc": None}, deed | {"a": None}]
    left = rows(spark, ARCHIVE, *(r | {"archive_id": i + 1} for i, r in enumerate(arch)))
    right = rows(spark, DEED, *(r | {"deed_id": i + 1} for i, r in enumerate(deeds)))
    got = link_deeds(left, right, towns(spark))
    exact = {1, 5, 7, 9, 13, 14}
    loose = exact | {2, 3, 10}
    assert as_set(got.filter("matched").select("archive_id", "deed_id")) == {(a, d) for a in (1, 7) for d in exact} | {(2, d) for d in loose} | {(6, d) for d in exact | {2}}
    assert got.filter("confidence < 0 or confidence > 1 or confidence is null").count() == 0


def test_limits_decide_at_the_edges_of_bins_and_bands(spark):
    rng = np.random.default_rng(5)
    flat = {"type": "flat", "locality": "Prupatyń", "delisted": D(2024, 6, 1)}
    arch = [flat | {"archive_id": i + 1, "area": float(rng.integers(300, 420)) / 10, "title": t, "rooms": r, "price": p} for i, (t, r, p) in enumerate((t, r, p) for t in ("Dom, ul. Polna", "Dom") for r in (None, 2) for p in (None, 0, 100_000, 250_000) for _ in range(6))]
    deeds = [{"deed_id": j + 1, "kind": "flat", "msc": "Prupatyń", "d": D(2024, 7, 1), "a": float(rng.integers(2940, 4260)) / 100, "ul": u, "izb": z, "c": c} for j, (u, z, c) in enumerate((u, z, c) for u in ("POLNA", None, "Zzyzxowa") for z in (None, 2, 3) for c in (None, 88_000, 95_000, 112_000, 112_100, 260_000) for _ in range(4))]
    want = {
        (x["archive_id"], y["deed_id"])
        for x in arch
        for y in deeds
        if abs(x["area"] - y["a"]) <= 0.6 + 1e-9
        and (x["rooms"] is None or y["izb"] is None or x["rooms"] == y["izb"])
        and (not x["price"] or y["c"] is None or abs(x["price"] - y["c"]) <= 0.12 * x["price"])
        and (x["title"] == "Dom" or y["ul"] != "Zzyzxowa")
    }
    got = link_deeds(rows(spark, ARCHIVE, *arch), rows(spark, DEED, *deeds), towns(spark)).filter("matched").select("archive_id", "deed_id")
    assert got.count() == len(want) and as_set(got) == want


def test_candidates_do_not_grow_with_a_town(spark):
    # Other properties of one town and area, on other streets: no candidates, however many there are.
    street = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7, 11, 17, 19))
    for n in (12, 24):
        arch = [{"archive_id": i, "type": "flat", "area": 50.0, "locality": "Prupatyń", "title": f"Dom, ul. {street(i)}", "price": 100_000, "delisted": D(2024, 6, 1)} for i in range(n)]
        deeds = [{"deed_id": i, "kind": "flat", "area": 50.0, "msc": "Prupatyń", "d": D(2024, 7, 1), "a": 50.0, "ul": street(i), "c": 100_000} for i in range(n)]
        got = link_deeds(rows(spark, ARCHIVE, *arch), rows(spark, DEED, *deeds), towns(spark))
        assert as_set(got.filter("matched").select("archive_id", "deed_id")) == {(i, i) for i in range(n)}
        assert got.count() < 6 * n


def test_empty(spark):
    assert link_deeds(rows(spark, ARCHIVE), rows(spark, DEED), towns(spark)).count() == 0
