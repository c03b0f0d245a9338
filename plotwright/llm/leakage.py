"""Evaluation texts inside a corpus: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass over the corpus reduces every document to word hashes and keeps the documents that
   contain any ``seed``-gram of a test item, with those n-grams.
2. Document frequencies of the items' n-grams are counted over the whole corpus; every window of
   ``window`` consecutive item words elects its rarest n-gram as a seed. So each exact passage of at
   least ``window`` words contains a seed, and common phrases elect nothing that rarer words could.
3. Documents and items that share a seed are aligned word by word (Smith-Waterman, linear gaps),
   which gives the longest run of equal consecutive words.

Edited copies need no seed. :func:`find_edited` gives every document and item whose alignment reaches the threshold: pairs are
left out only by an upper bound of their score (:func:`spans`), and words only where no alignment can pass.

Words are runs of letters and digits; case, diacritics, punctuation and spacing are ignored.

Defined results
---------------
* null or empty texts contain nothing; items shorter than ``seed`` words cannot be found.
* texts of any length are read whole; repeated documents and items are reported under each id.
* empty tables give empty results; columns other than the ids and texts are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import fold_py
from plotwright.session import materialize, spread

SEED, WINDOW = 5, 12
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of all test items that one alignment table holds; a larger test set is searched block by block.
BLOCK_WORDS = 5_000_000
#: Words and items of one table of :class:`Vocabulary`; cells that an intermediate table of the alignment holds.
TABLE_WORDS, TABLE_ITEMS, CELLS = 50_000, 1_000, 1 << 20


class WordHashes(dict):
    """64-bit hash of each word, without case and diacritics, computed once per distinct spelling."""

    def __missing__(self, word: str) -> int:
        plain = fold_py(word)
        if not plain.isascii():
            plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(plain)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text."""
        if not text:
            return np.zeros(0, np.uint64)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each window of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ words[i : len(words) - n + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def elect_seeds(items: list[tuple[int, np.ndarray]], frequency: dict[int, int], seed: int, window: int) -> dict[int, set[int]]:
    """n-gram hash -> items: the rarest n-gram that occurs at all, of every window of every item (of the whole item if shorter)."""
    seeds: dict[int, set[int]] = defaultdict(set)
    for item, words in items:
        grams = ngram_hashes(words, seed)
        width = max(1, min(len(grams), window - seed + 1))
        for i in range(len(grams) - width + 1):
            part = [g for g in grams[i : i + width].tolist() if frequency.get(g)]
            if part:
                seeds[min(part, key=lambda g: (frequency[g], g))].add(item)
    return seeds


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, longest run of equal consecutive words) of two word sequences."""
    n = len(doc)
    score, run = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best = longest = 0
    steps = np.arange(n + 1) * -GAP
    for word in item:
        same = doc == word
        now = np.zeros(n + 1, np.int64)
        np.maximum(score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP, out=now[1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + steps) - steps  # gaps along the document
        runs = np.zeros(n + 1, np.int64)
        runs[1:] = np.where(same, run[:-1] + 1, 0)
        best, longest = max(best, int(now.max())), max(longest, int(runs.max()))
        score, run = now, runs
    return best, longest


def _hit_task(grams: np.ndarray, seed: int):
    """Documents that contain any of the sorted ``grams``: their words, and which n-grams they contain."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            docs, words, hits = [], [], []
            lists = [hashes.of(t) for t in b["text"].to_pylist()]
            if not lists:
                continue
            flat = np.concatenate(lists)
            all_grams = ngram_hashes(flat, seed)
            at = np.searchsorted(grams, all_grams)
            known = grams[np.minimum(at, len(grams) - 1)] == all_grams if len(grams) else np.zeros(len(all_grams), bool)
            ends = np.cumsum([len(x) for x in lists])
            spots = np.flatnonzero(known)
            owner = np.searchsorted(ends, spots, "right")
            whole = spots + seed <= ends[owner] if len(spots) else np.zeros(0, bool)
            spots, owner = spots[whole], owner[whole]
            ids = b["doc_id"].to_pylist()
            for d in np.unique(owner):
                docs.append(ids[d])
                words.append(lists[d].view(np.int64))
                hits.append(np.unique(all_grams[spots[owner == d]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64()))], names=["doc_id", "words", "hits"])

    return run


def _around(spots: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """Merged spans of ``reach`` words to both sides of the spots."""
    lo, hi = np.maximum(spots - reach, 0), np.minimum(spots + reach, n)
    cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    return [(int(a[0]), int(b[-1])) for a, b in zip(np.split(lo, cut), np.split(hi, cut))]


def _align_task(items: dict[int, np.ndarray], seeds: dict[int, set[int]], seed: int):
    known = np.array(sorted(seeds), np.uint64)

    def run(batches):
        for b in batches:
            out = []
            for doc, words in zip(b["doc_id"].to_pylist(), b["words"]):
                w = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                grams = ngram_hashes(w, seed)
                at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                spots = np.flatnonzero(known[at] == grams) if len(known) else []
                of_item = defaultdict(list)
                for s in spots:
                    for item in seeds[int(grams[s])]:
                        of_item[item].append(s)
                for item, own in sorted(of_item.items()):
                    # A passage and its edits lie within twice the item's length around a seed.
                    parts = [align(w[a:z], items[item]) for a, z in _around(np.array(own), 2 * len(items[item]) + seed, len(w))]
                    out.append((doc, item, max(p[0] for p in parts), max(p[1] for p in parts), len(items[item])))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "score", "run", "item_words"])

    return run


class Vocabulary:
    """Test items as codes of their words, and which item has which word."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.words, codes = np.unique(np.concatenate([w for _, w in items]), return_inverse=True)
        ends = np.cumsum([len(w) for _, w in items])
        self.ids = [i for i, _ in items]
        self.items = [c.astype(np.int32) for c in np.split(codes, ends[:-1])]
        self.least = np.array([least_score(len(w)) for _, w in items])
        self.lowest = int(self.least.min())
        self.ones = np.ones((max(len(w) for _, w in items), 1), np.int8)
        self.has = np.zeros((len(self.words), len(items)), np.int8)
        for k, c in enumerate(self.items):
            self.has[c, k] = 1

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of words; -1 for those of no item."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1).astype(np.int32)


def least_score(n: int) -> int:
    """Score from which a document counts as an edited copy of an item of ``n`` words."""
    return max(2 * WINDOW, math.ceil(n * 0.2))


def spans(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bound of the score, and of the score that an alignment can have before each word, for words at positions ``at``.

    ``member`` (words x items) says which of them the other text has; the words between them it has not. A word
    scores at most ``MATCH`` if the other text has it, and costs at least one if not, be it mismatch or gap. So no alignment
    scores more than the best sum of consecutive words, and where the running sum falls to 0 none goes on.
    """
    gain = member.astype(np.int32) * (MATCH + 1)
    after = np.cumsum(gain, axis=0, dtype=np.int32) - (at[:, None].astype(np.int32) + 1)
    before = after - gain + 1
    low = np.minimum.accumulate(before, axis=0)
    return (after - low).max(axis=0), before - low


def _kept(at: np.ndarray, carried: np.ndarray, n: int, least: int) -> np.ndarray:
    """Positions of the stretches of a text of ``n`` words in which an alignment can score ``least``.

    ``at``: the words that the other text has, ``carried``: the bound before each of them. A stretch ends where
    the bound is back at 0, so nothing reaches from one to the next, and no run does.
    """
    starts = np.flatnonzero(carried == 0)
    high = np.maximum.reduceat(carried, starts) + MATCH >= least
    ends = np.minimum(at + carried + MATCH, np.append(at[1:] - 1, n - 1))
    if not high.all():
        some = np.repeat(high, np.diff(np.append(starts, len(at))))
        at, ends = at[some], ends[some]
    sizes = ends - at + 1
    return np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def align_many(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`align` of many pairs at once, by anti-diagonals; codes of words, where a document's words may be -1."""
    scores, runs = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    order = sorted(range(len(docs)), key=lambda k: (len(docs[k]) + len(items[k]), len(items[k])))
    at = 0
    while at < len(order):
        part = order[at : at + 128]
        while len(part) > 1 and len(part) * (max(len(docs[k]) for k in part) + 2 * max(len(items[k]) for k in part)) > CELLS:
            part = part[: len(part) // 2]
        at += len(part)
        n, m = max(len(docs[k]) for k in part), max(len(items[k]) for k in part)
        kind = np.int16 if 2 * min(n, m) < 32_000 else np.int32
        item = np.full((m, len(part)), -2, np.int32)
        back = np.full((n + 2 * m, len(part)), -1, np.int32)  # the document backwards, m blank words on both sides
        for c, k in enumerate(part):
            item[: len(items[k]), c] = items[k]
            back[m + n - len(docs[k]) : m + n, c] = docs[k][::-1]
        # Row 0 of each table is the border before the item's first word.
        last, last2, now, run, run2, own = (np.zeros((m + 1, len(part)), kind) for _ in range(6))
        best, longest, gaps, gain = (np.zeros((m, len(part)), kind) for _ in range(4))
        same = np.zeros((m, len(part)), bool)
        for t in range(n + m - 1):
            np.equal(back[m + n - 1 - t : 2 * m + n - 1 - t], item, out=same)
            np.multiply(same, kind(MATCH - MISMATCH), out=gain)
            gain += kind(MISMATCH)
            gain += last2[:-1]
            np.maximum(last[1:], last[:-1], out=gaps)
            gaps += kind(GAP)
            np.maximum(gaps, gain, out=now[1:])
            np.maximum(now, kind(0), out=now)
            np.add(run2[:-1], kind(1), out=own[1:])
            own[1:] *= same
            np.maximum(best, now[1:], out=best)
            np.maximum(longest, own[1:], out=longest)
            last2, last, now, run2, run, own = last, now, last2, run, own, run2
        scores[part], runs[part] = best.max(axis=0), longest.max(axis=0)
    return scores, runs


class _Pair:
    """A document and an item that may score enough, by codes, with the words each has of the other and the bounds before these."""

    __slots__ = ("doc", "k", "codes", "at", "carried", "item", "place", "held")

    def __init__(self, *values) -> None:
        for name, value in zip(self.__slots__, values):
            setattr(self, name, value)

    def parts(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """What of document and item can hold an alignment that scores ``least``."""
        return self.codes[_kept(self.at, self.carried, len(self.codes), least)], self.item[_kept(self.place, self.held, len(self.item), least)]


def _candidates(v: Vocabulary, doc: int, codes: np.ndarray):
    """Pairs of a document whose score may reach the item's threshold."""
    at = np.flatnonzero(codes >= 0)
    if MATCH * len(at) < v.lowest:
        return
    known = codes[at]
    step = max(1, CELLS // len(v.ids))
    met = sum(v.has[known[i : i + step]].sum(axis=0, dtype=np.int32) for i in range(0, len(known), step))
    some = np.flatnonzero(MATCH * met >= v.least)
    present = np.zeros(len(v.words), bool)
    present[known] = True
    step = max(1, CELLS // len(at))
    for part in (some[i : i + step] for i in range(0, len(some), step)):
        member = v.has[known][:, part] if len(v.ids) <= step else v.has[np.ix_(known, part)]
        top, carried = spans(member, at)
        for c in np.flatnonzero(top >= v.least[part]).tolist():
            k = int(part[c])
            place = np.flatnonzero(present[v.items[k]])
            best, held = spans(v.ones[: len(place)], place)
            if best[0] >= v.least[k]:
                mine = np.flatnonzero(member[:, c])
                yield _Pair(doc, k, codes, at[mine], carried[mine, c], v.items[k], place, held[:, 0])


def _scored(v: Vocabulary, pairs: list[_Pair]):
    """(pair, score, longest run) of the pairs that reach their item's threshold."""
    parts = _columns(p.parts(v.least[p.k]) for p in pairs)
    scores, runs = align_many(*parts)
    good = [k for k, p in enumerate(pairs) if scores[k] >= v.least[p.k]]
    # A longer run may stand where no alignment scores enough.
    more = [(k, pairs[k].parts(MATCH * (runs[k] + 1))) for k in good if MATCH * (runs[k] + 1) < v.least[pairs[k].k]]
    more = [(k, (x, y)) for k, (x, y) in more if (len(x), len(y)) != (len(parts[0][k]), len(parts[1][k]))]
    _, longer = align_many(*_columns(p for _, p in more))
    for (k, _), run in zip(more, longer):
        runs[k] = max(runs[k], run)
    return [(pairs[k], int(scores[k]), int(runs[k])) for k in good]


def _columns(parts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = list(parts)
    return [p[0] for p in parts], [p[1] for p in parts]


def _edited_task(items: list[tuple[int, np.ndarray]]):
    def run(batches):
        tables, part, words = [], [], 0
        for item in items:
            if part and (words + len(item[1]) > TABLE_WORDS or len(part) == TABLE_ITEMS):
                tables.append(Vocabulary(part))
                part, words = [], 0
            part.append(item)
            words += len(item[1])
        tables += [Vocabulary(part)] if part else []
        hashes = WordHashes()
        for b in batches:
            lists = [hashes.of(t) for t in b["text"].to_pylist()]
            ids, out = b["doc_id"].to_pylist(), [[] for _ in range(5)]
            flat, ends = np.concatenate([np.zeros(0, np.uint64), *lists]), np.cumsum([len(x) for x in lists])[:-1]
            for v in tables:
                found = [p for d, own in enumerate(np.split(v.codes(flat), ends)) for p in _candidates(v, d, own)] if lists else []
                for p, score, longest in _scored(v, found):
                    for column, value in zip(out, (ids[p.doc], v.ids[p.k], score, longest, len(p.item))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "item_id", "score", "run", "item_words"])

    return run


def find_edited(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, run, item_words`` for every document and item whose alignment scores at least :func:`least_score`."""
    return _by_blocks(documents, items, _edited_of)


def _edited_of(documents: DataFrame, items: DataFrame) -> DataFrame:
    hashes = WordHashes()
    listed = [(r["item_id"], hashes.of(r["text"])) for r in items.select("item_id", "text").collect()]
    listed = [(i, w) for i, w in listed if MATCH * len(w) >= least_score(len(w))]  # fewer words cannot score enough
    docs = spread(documents.select("doc_id", "text")).filter(F.col("text") != "")
    return docs.mapInArrow(_edited_task(listed), "doc_id bigint, item_id bigint, score bigint, run bigint, item_words bigint")


def find_leaks(documents: DataFrame, items: DataFrame, seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, score, run, item_words`` for every document and item that share a seed: all that share ``window`` words in a row.

    ``score`` is the local alignment score (2 a common word, -1 a differing, missing or added one),
    ``run`` the longest run of equal consecutive words.
    """
    if window < seed:
        raise ValueError("a window must hold at least one seed")
    return _by_blocks(documents, items, lambda docs, part: _leaks_of(docs, part, seed, window))


def _by_blocks(documents: DataFrame, items: DataFrame, search) -> DataFrame:
    sizes = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-sizes // (BLOCK_WORDS * 5)))
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        own = search(documents, part)
        found = own if found is None else found.unionByName(own)
    return found


def _leaks_of(documents: DataFrame, items: DataFrame, seed: int, window: int) -> DataFrame:
    hashes = WordHashes()
    listed = [(r["item_id"], hashes.of(r["text"])) for r in items.select("item_id", "text").collect()]
    grams = np.unique(np.concatenate([ngram_hashes(w, seed) for _, w in listed])) if listed else np.zeros(0, np.uint64)
    docs = spread(documents.select("doc_id", "text")).filter(F.col("text") != "")
    hits = materialize(docs.mapInArrow(_hit_task(grams, seed), "doc_id bigint, words array<bigint>, hits array<bigint>"), "leak-hits")
    # Only n-grams of the items are counted: at most as many as the items have words.
    counted = hits.select(F.explode("hits").alias("g")).groupBy("g").count().collect()
    frequency = {r["g"] & 0xFFFFFFFFFFFFFFFF: r["count"] for r in counted}
    seeds = elect_seeds(listed, frequency, seed, window)
    return spread(hits.select("doc_id", "words")).mapInArrow(_align_task(dict(listed), seeds, seed), "doc_id bigint, item_id bigint, score bigint, run bigint, item_words bigint")
