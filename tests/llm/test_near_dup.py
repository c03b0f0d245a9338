import random

import numpy as np
import pytest

import plotwright.llm.near_dup as nd
from plotwright.llm.pairs import class_rows
from tests.fixtures import as_set, listing

WORDS = [f"w{i}" for i in range(60)]


def brute(rs):
    out = set()
    for a in rs:
        for b in rs:
            if a["seq"] < b["seq"] and a["type"] == b["type"] and a["type"] and all(x.get("area") and x.get("price") for x in (a, b)):
                near = lambda c, t: abs(a[c] - b[c]) <= t * max(a[c], b[c])  # noqa: E731, B023
                wa, wb = (set((x.get("title") or "").lower().split()) for x in (a, b))
                pic = a.get("image") and a.get("image") == b.get("image")
                if near("area", 0.02) and near("price", 0.06) and (pic or (wa | wb) and len(wa & wb) >= 0.6 * len(wa | wb)):
                    out.add((a["seq"], b["seq"]))
    return out


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            r = dict(rng.choice(out))
            title = (r["title"] or "").split()
            if title and rng.random() < 0.6:
                title[rng.randrange(len(title))] = rng.choice(WORDS)
            r |= {"title": " ".join(title) if rng.random() < 0.95 else None, "area": r["area"] and round(r["area"] * (1 + rng.choice([0, 0, 0.01, -0.015, 0.03])), 2), "price": r["price"] and int(r["price"] * (1 + rng.choice([0, 0.02, -0.05, 0.08])))}
        else:
            r = {"type": rng.choice(["flat", "house", None]), "area": rng.choice([None, 0.0, *[round(rng.uniform(30, 60), 2) for _ in range(8)]]), "price": rng.choice([None, 0, *[rng.randrange(200_000, 400_000) for _ in range(8)]]), "title": " ".join(rng.sample(WORDS, rng.randrange(4, 14))), "image": rng.choice([None, "", f"https://x.example/{rng.randrange(5)}a1b2c3d4e5f607.jpg"])}
        out.append(r | {"seq": i + 1})
    return out


@pytest.mark.parametrize("block", [nd.BLOCK, 25, 1])
def test_all_close_pairs(spark, block):
    rs = sample(300, 3)
    got = nd.near_duplicate_pairs(listing(spark, *rs), block=block)
    assert as_set(got) == brute(rs) and got.count() == len(brute(rs))


def test_repeated_rows_long_titles_and_empty_table(spark):
    long = " ".join(f"t{i}" for i in range(3000))
    base = {"type": "flat", "area": 50.0, "price": 100_000}
    df = listing(spark, *[base | {"title": long}] * 3, base | {"title": ""}, base | {"title": ""}, base | {"title": long + " more"})
    assert as_set(nd.near_duplicate_pairs(df)) == {(a, b) for a in (1, 2, 3, 6) for b in (1, 2, 3, 6) if a < b}
    assert nd.near_duplicate_pairs(listing(spark)).count() == 0


def test_classes_without_expansion(spark):
    base = {"type": "flat", "area": 50.0, "price": 100_000, "title": "dom ogród taras garaż piwnica"}
    df = listing(spark, *[base] * 50, base | {"area": 50.5}, base | {"title": "inne słowa"}, base | {"title": "inny napis"})
    links, members = nd.near_duplicate_classes(df)
    assert as_set(links) == {(1, 51)} and members.count() == 50
    assert as_set(class_rows(links, members)) == {(k, 1, 1) for k in range(1, 51)} | {(51, 51, 1)}


def test_picture_files(spark):
    same = ["https://n.example/photos/6ba2d5d3861ea1.jpg", "https://n.example/foto/6ba2d5d3861ea1-1.jpeg#main", "https://n.example/thumbs/640x480/6ba2d5d3861ea1.jpg", "https://m.example/v1/files/6ba2d5d3861ea1/image;s=1000x750", "http://cdn4.n.example/6b/a2/6BA2D5D3861EA1.JPG", "https://m.example/6ba2d5d3861ea1_xl.webp?sig=84"]
    none = ["https://s.example/static/placeholder.webp", "https://s.example/assets/brak-zdjecia.png", "https://s.example/no-photo_320x240.jpg", "", None]
    df = spark.createDataFrame([(u,) for u in same + none], "u string")
    assert [r[0] for r in df.select(nd.picture_file(df.u)).collect()] == ["6ba2d5d3861ea1"] * 6 + [None] * 5


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    sk, n = nd.OddSketcher(), 400
    for share, most in ((0.9, 0.05), (0.7, 0.08)):
        errors = []
        for _ in range(30):
            common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            extra = rng.integers(0, 2**63, (2, (n - int(n * share)) // 2), dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, e])) for e in extra]
            mins = sk.minhash(np.concatenate(sets), np.array([0, len(sets[0])]))
            s = sk.sketch(mins)
            ones = int(np.bitwise_count(s[0] ^ s[1]).sum())
            estimate = 1 + nd.BITS / (4 * nd.SAMPLES) * np.log(1 - 2 * ones / nd.BITS)
            errors.append(estimate - len(common) / len(np.union1d(*sets)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < most


def test_equal_pairs_in_parts():
    keys, at = np.array([5, 1, 5, 5, 2, 1]), np.arange(6)
    got = {tuple(sorted(p)) for a, b in nd.equal_pairs(keys, at, limit=1) for p in zip(a.tolist(), b.tolist())}
    assert got == {(0, 2), (0, 3), (2, 3), (1, 5)}


@pytest.mark.parametrize("crowd", [1, 64])
def test_crowded_cells_by_key_and_in_a_task(spark, monkeypatch, crowd):
    monkeypatch.setattr(nd, "CROWD", crowd)
    rng = random.Random(9)
    rs = [r | {"area": 50.0 + r["seq"] % 3, "price": 300_000 + 1_000 * (r["seq"] % 30), "type": "flat"} for r in sample(300, 9)]
    rs += [dict(rng.choice(rs), seq=300 + k, title=" ".join(rng.sample(WORDS, 6))) for k in range(1, 60)]
    assert as_set(nd.near_duplicate_pairs(listing(spark, *rs), block=4)) == brute(rs)


def test_a_full_cell_sends_no_class_once_a_key(spark, monkeypatch):
    made = []
    monkeypatch.setattr(nd, "materialize", lambda df, name="table", keep=nd.materialize: made.append(name) or keep(df, name))
    n = 6_000  # more than 16,384 with the copies of a cell of the finest grid
    df = listing(spark).sparkSession.range(1, n + 1).selectExpr("id AS seq", "'flat' AS type", "50.0D AS area", "300000L AS price", "concat_ws(' ', transform(sequence(0, 7), i -> concat('w', (id - id % 3) * 10 + i + if(i = 0, id % 3, 0)))) AS title", "CAST(NULL AS string) AS image")
    assert as_set(nd.near_duplicate_pairs(df)) == {(a, b) for a in range(1, n + 1) for b in (a + 1, a + 2) if a // 3 == b // 3 and b <= n}
    assert "sketches" not in made
