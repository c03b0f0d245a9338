import numpy as np
import pytest

from plotwright.llm.packing import TOKENIZER, Bm25, encoder, fill, pack_documents

SCHEMA = "doc_id bigint, text string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 60, 120)]
    texts += [texts[0]] * 5 + ["", None, "  ", " ".join(rng.choice(words, 5000)), "<|endoftext|> plain text"]
    return {i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("shard", [2048, 25])
def test_every_token_has_one_place(spark, docs, shard, monkeypatch):
    monkeypatch.setattr("plotwright.llm.packing.PARTITIONS", 3)
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], SCHEMA)
    got = pack_documents(df, capacity=128, shard=shard).collect()
    sizes = {i: len(encoder(TOKENIZER).encode_ordinary(t)) for i, t in docs.items() if t}
    spans, used = {}, {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"], r["piece"]))
        used.setdefault(r["container"], []).append((r["place"], r["n_tokens"], r["used"]))
    assert set(spans) == set(sizes)
    for d, own in spans.items():
        own.sort()
        assert len(own) == -(-sizes[d] // 128), "cut only when longer than a container"
        assert [p for *_, p in own] == list(range(len(own)))
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(n for _, n, _ in own) == sizes[d]
    for own in used.values():
        assert sum(n for _, n, _ in own) == own[0][2] <= 128 and sorted(p for p, *_ in own) == list(range(len(own)))
    assert len(used) <= -(-sum(sizes.values()) // 128) * 1.03 + 1


def test_neighbours_share_rare_terms():
    terms = [np.array(t) for t in ([1, 2, 9], [1, 2, 3], [1, 7, 8], [1, 2, 9], [1, 4, 5])]
    s = Bm25(terms, [np.ones(3, np.int8)] * 5).scores(0)
    assert list(np.argsort(-s, kind="stable"))[:3] == [0, 3, 1] and s[4] < s[1]


def test_dense_and_sparse_terms_agree():
    rng = np.random.default_rng(1)
    terms = [np.unique(np.concatenate([rng.integers(0, 20, 8), rng.integers(20, 4000, 8)])) for _ in range(300)]
    counts = [np.full(len(t), 2, np.int8) for t in terms]
    index = Bm25(terms, counts)
    assert (index.row >= 0).any() and (index.row < 0).any()
    want = np.zeros(300)
    n, length = 300, np.array([2.0 * len(t) for t in terms])
    for t in terms[7]:
        has = np.array([t in x for x in terms])
        df = has.sum()
        want += has * np.log1p((n - df + 0.5) / (df + 0.5)) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length / length.mean()))
    assert np.allclose(index.scores(7), want, rtol=1e-4, atol=1e-5)


def test_fill_closes_gaps_exactly():
    sizes = np.array([60, 50, 40, 30, 20])
    empty = [np.zeros(0, int)] * 5
    boxes = fill(sizes, Bm25(empty, empty), 100)
    assert sorted(x for b in boxes for x in b) == [0, 1, 2, 3, 4] and len(boxes) == 2


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
