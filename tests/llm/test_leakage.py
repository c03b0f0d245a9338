import random

import numpy as np
import pytest

from plotwright.llm.leakage import WordHashes, align, elect_seeds, find_edited, find_leaks, ngram_hashes
from plotwright.llm.queries import p9_edited
from tests.fixtures import as_set

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string"


def test_alignment_agrees_with_the_textbook():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        r = h.copy()
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                same = a[j - 1] == b[i - 1]
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                r[i, j] = r[i - 1, j - 1] + 1 if same else 0
        assert align(np.array(a, np.uint64), np.array(b, np.uint64)) == (h.max(), r.max())


def test_every_window_elects_its_rarest_seed():
    words = np.arange(30, dtype=np.uint64)
    grams = ngram_hashes(words, 5).tolist()
    seeds = elect_seeds([(1, words)], {g: 100 - i for i, g in enumerate(grams)}, 5, 12)
    assert all(any(g in seeds for g in grams[i : i + 8]) for i in range(19))
    assert set(seeds) == set(grams[7:])


def naive(docs, items, k=12):
    hashes = WordHashes()
    grams = lambda t: set(ngram_hashes(hashes.of(t), k).tolist())
    have = {i: grams(t) for i, t in items if t}
    return {(d, i) for d, t in docs if t for i, g in have.items() if g & grams(t)}


def test_planted_passages(spark):
    rng = random.Random(7)
    vocab = [f"słowo{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(6)] + [(6, "too short an item"), (7, None), (8, "")]
    words = lambda i, a, b: items[i][1].split()[a:b]
    noise = lambda n: [rng.choice(vocab) for _ in range(n)]
    plain = " ".join
    docs = [
        plain(noise(50) + words(0, 3, 15) + noise(9)),
        plain(noise(50) + words(1, 3, 14) + noise(9)),  # 11 words: one too few
        ", ".join(words(2, 0, 20)).upper().replace("S", "S").replace("Ł", "L"),
        plain(noise(3000) + words(3, 10, 40) + noise(3000) + words(4, 0, 13)),
        plain(words(5, 0, 10) + ["inne"] + words(5, 11, 20) + ["inne"] + words(5, 21, 30)),  # edited
        "", None, plain(noise(30)),
    ]
    listed = list(enumerate(docs)) + [(100, docs[0])]
    got = find_leaks(spark.createDataFrame([(d, t, "clash") for d, t in listed], DOCS), spark.createDataFrame(items, ITEMS))
    assert as_set(got.filter("run >= 12").select("doc_id", "item_id")) == naive(listed, items) == {(0, 0), (100, 0), (2, 2), (3, 3), (3, 4)}
    edited = {(r["doc_id"], r["item_id"]): r["score"] for r in got.filter("run < 12").collect()}
    assert edited[4, 5] == 2 * 28 - 2 and (1, 1) in edited


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g", "")], DOCS), spark.createDataFrame([(1, "a b c d e f g h i j k l m")], ITEMS)
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_edited_copies_agree_with_brute_force(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"słowo{i}" for i in range(300)]
    common = ["i", "w", "na", "z", "do"]
    items = [(i, " ".join(rng.choice(common if rng.random() < 0.3 else vocab) for _ in range(60))) for i in range(8)] + [(8, None), (9, "i w na")]

    def edited(i, every, a=0, b=60):
        return ["inne" if j % every == 2 else w for j, w in enumerate(items[i][1].split()[a:b])]

    noise = lambda n: [rng.choice(common if rng.random() < 0.5 else vocab) for _ in range(n)]
    texts = [" ".join(noise(rng.randrange(0, 60)) + part + noise(rng.randrange(0, 60))) for i in range(8) for part in (items[i][1].split(), edited(i, 6), edited(i, 7), edited(i, 4), edited(i, 8, 10, 25))]
    texts += [" ".join(noise(2000) + edited(0, 5, 0, 30) + noise(500) + items[0][1].split()[30:38] + noise(900)), "", None, *(" ".join(noise(200)) for _ in range(5))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/eval_item.parquet")
    hashes = WordHashes()
    want = {(d, i, *align(hashes.of(t), hashes.of(x)), len(hashes.of(x))) for d, t in enumerate(texts) if t for i, x in items if x}
    want = {w for w in want if w[2] >= 24}
    assert as_set(p9_edited(spark, str(tmp_path))) == want
    assert all((5 * i + k, i) in {w[:2] for w in want} for i in range(8) for k in range(4))


@pytest.mark.parametrize("every", [3, 5, 8])
def test_planted_copies_with_words_exchanged_are_found(spark, every):
    # One word in three, five or eight exchanged, beside an exact copy of the same item in the corpus.
    rng = random.Random(every)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [[word() for _ in range(60)] for _ in range(8)]
    noise = lambda n: [word() for _ in range(n)]
    changed = lambda it: [word() if k % every == 0 else w for k, w in enumerate(it)]
    docs = [noise(40) + changed(it) + noise(40) for it in items] + [noise(10) + it for it in items] + [noise(100) for _ in range(10)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = as_set(find_edited(d, e).select("doc_id", "item_id"))
    assert got == {(i, i) for i in range(8)} | {(i + 8, i) for i in range(8)}
