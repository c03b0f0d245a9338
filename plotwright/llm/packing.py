"""Documents packed whole into containers of fixed capacity: lexical retrieval packing.

Sizes are tokens of a public tokenizer. A document longer than the capacity is cut into full
containers; its rest, like every other document, is an item that is never cut. Items are
range-partitioned by a lexical signature into shards of a bounded number of items, so near copies
meet. Each shard builds a BM25 inverted index; the largest unused item seeds a container and its
best-scoring unused neighbours fill it while room is ample, after which the largest item that still
fits closes the gap. A shard ends with one container that may be poorly filled; the shards' last
containers are packed once more together.

Defined results
---------------
* null and empty texts have no tokens and no place in any container (no row).
* repeated documents are packed as often as they occur; ties go to the smaller doc_id.
* texts of any length are tokenised whole; empty tables give an empty result; columns other than doc_id and text are not read.
* the terms of the index are the tokens themselves.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.session import discard, materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 4096
#: Items of one shard: bounds the memory of a task.
SHARD = 2048
#: Range partitions at most: what is sampled for their bounds does not grow with the data. A task cuts its partition into shards as it reads.
PARTITIONS = 4096
#: Share of the capacity below which the remaining room is closed by size instead of by likeness.
ROOM = 0.25
#: Containers filled less than this are opened and packed once more.
LOOSE = 0.9
K1, B = 1.2, 0.75
# Fixed value: how the byte-level vocabularies cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _ENCODERS:
        import tiktoken

        # A machine without the file takes the one that the driver sent along.
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("pack", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, kind)))


def _size_task(path: str):
    """Token count, distinct tokens with counts, and lexical signature of each document."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids, sizes, terms, counts, signs = [], [], [], [], []
            for d, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                if not text:
                    continue
                tokens = np.array(enc.encode_ordinary(text), np.int32)
                t, k = np.unique(tokens, return_counts=True)
                ids.append(d)
                sizes.append(len(tokens))
                terms.append(t)
                counts.append(k.astype(np.int32))
                # The smallest two of the mixed tokens: a MinHash of two samples, so near copies sort together.
                mixed = t.astype(np.uint32) * np.uint32(2654435769)
                mixed = np.partition(mixed ^ (mixed >> np.uint32(15)), min(1, len(t) - 1))[:2]
                signs.append(int(mixed[0]) << 31 | int(mixed[-1]) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(terms, np.int32), _lists(counts, np.int32), pa.array([x & 0x7FFFFFFFFFFFFFFF for x in signs], pa.int64())], names=["doc_id", "n_tokens", "terms", "counts", "sign"])

    return run


class Bm25:
    """Inverted index of one shard: for each term its documents and their BM25 weights; frequent terms as dense rows."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        n = self.n = len(terms)
        length = np.array([c.sum(dtype=np.int64) for c in counts], float)
        sizes = np.array([len(t) for t in terms])
        flat, tf, doc = np.concatenate(terms), np.concatenate(counts).astype(float), np.repeat(np.arange(n), sizes)
        vocabulary, self.ids = np.unique(flat, return_inverse=True)
        df = np.bincount(self.ids, minlength=len(vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = (idf[self.ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(length.mean(), 1)))).astype(np.float32)
        # A term of more than n / 32 documents fills a row; there are at most 32 times as many as distinct terms in a document on average.
        self.row = np.full(len(vocabulary), -1)
        frequent = np.flatnonzero(df * 32 > n)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        in_row = self.row[self.ids] >= 0
        self.dense[self.row[self.ids[in_row]], doc[in_row]] = weight[in_row]
        order = np.argsort(self.ids, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.bounds, self.of = np.r_[0, np.cumsum(df)], np.r_[0, np.cumsum(sizes)]

    def scores(self, seed: int) -> np.ndarray:
        """Score of every document of the shard for the terms of document ``seed``."""
        own = self.ids[self.of[seed] : self.of[seed + 1]]
        rows = self.row[own]
        out = self.dense[rows[rows >= 0]].sum(axis=0)
        own = own[rows < 0]
        if len(own):
            starts, ends = self.bounds[own], self.bounds[own + 1]
            at = np.repeat(ends - np.cumsum(ends - starts), ends - starts) + np.arange(int((ends - starts).sum()))
            out = out + np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)
        return out


def fill(sizes: np.ndarray, index: Bm25, capacity: int, room: float = ROOM) -> list[list[int]]:
    """Containers as lists of item positions; every item is in one container."""
    order = np.argsort(-sizes, kind="stable")
    unused = np.ones(len(sizes), bool)
    by_size = np.argsort(sizes, kind="stable")  # ascending, for the closing fit
    sorted_sizes = sizes[by_size]
    containers = []
    for seed in order:
        if not unused[seed]:
            continue
        unused[seed] = False
        held, left = [int(seed)], capacity - int(sizes[seed])
        smallest = int(sizes[unused].min()) if unused.any() else capacity + 1
        if left >= max(room * capacity, smallest):
            liked = np.argsort(-np.where(unused & (sizes <= left), index.scores(seed), -1.0), kind="stable")
            for x in liked:
                if left < max(room * capacity, smallest):
                    break
                if unused[x] and sizes[x] <= left:
                    unused[x] = False
                    held.append(int(x))
                    left -= int(sizes[x])
        at = int(np.searchsorted(sorted_sizes, left, "right")) - 1
        while at >= 0 and left >= smallest:
            x = by_size[at]
            if unused[x] and sizes[x] <= left:
                unused[x] = False
                held.append(int(x))
                left -= int(sizes[x])
                at = min(at - 1, int(np.searchsorted(sorted_sizes, left, "right")) - 1)
            else:
                at -= 1
        containers.append(held)
    return containers


_OUT = "container string, place int, doc_id bigint, piece int, start_token bigint, n_tokens bigint, used bigint"


def _pack_task(capacity: int, shard: int, name: str):
    def rows_of(key: str, held, ids, starts, sizes, pieces):
        used = int(sum(sizes[i] for i in held))
        return [(key, k, int(ids[i]), int(pieces[i]), int(starts[i]), int(sizes[i]), used) for k, i in enumerate(held)]

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 7
        types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in _OUT.split(", ")])

    def pack(tables):
        t = pa.Table.from_batches(tables)
        ids, n = t["doc_id"].to_numpy(), t["n_tokens"].to_numpy()
        first = t["start_token"].to_numpy()
        full, rest = n // capacity, n % capacity
        out = []
        for i in np.flatnonzero((full > 0) & (n > capacity) | (n == capacity)):
            out += [(f"{ids[i]}-{first[i] + k * capacity}", 0, int(ids[i]), int(k), int(first[i] + k * capacity), capacity, capacity) for k in range(int(full[i]))]
        small = np.flatnonzero(rest > 0)
        if len(small):
            terms = [t["terms"][int(i)].values.to_numpy(zero_copy_only=False).view(np.uint32) for i in small]
            counts = [t["counts"][int(i)].values.to_numpy(zero_copy_only=False) for i in small]
            starts, pieces = first[small] + full[small] * capacity, np.maximum(full[small], t["piece"].to_numpy()[small])
            for held in fill(rest[small], Bm25(terms, counts), capacity):
                out += rows_of(f"{name}-{ids[small[held[0]]]}-{starts[held[0]]}", held, ids[small], starts, rest[small], pieces)
        return out

    def run(batches):
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, shard - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == shard:
                    yield batch(pack(held))
                    held, n = [], 0
        if n:
            yield batch(pack(held))

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """``container, place, doc_id, piece, start_token, n_tokens, used``: one row per item and container.

    ``piece`` and ``start_token`` place the item in its document; ``used`` is the container's number of
    tokens; ``container`` is named after its seed.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    sized = spread(documents.select("doc_id", "text")).mapInArrow(_size_task(tokenizer), "doc_id bigint, n_tokens bigint, terms array<int>, counts array<int>, sign bigint")
    # Written, since range partitioning reads its input twice.
    written = materialize(sized, "sized")
    items = written.withColumn("start_token", F.lit(0).cast("bigint")).withColumn("piece", F.lit(0))
    shards = max(1, min(PARTITIONS, -(-items.count() // shard)))
    placed = items.repartitionByRange(shards, "sign", "doc_id").sortWithinPartitions("sign", "doc_id")
    packed = materialize(placed.mapInArrow(_pack_task(capacity, shard, "c"), _OUT), "packed")
    discard(written)
    # Each shard leaves a container or two with much room; those are opened and packed together, by size.
    loose = F.col("used") < int(LOOSE * capacity)
    left = packed.filter(loose).select("doc_id", "n_tokens", F.array().cast("array<int>").alias("terms"), F.array().cast("array<int>").alias("counts"), "start_token", "piece")
    again = max(1, min(PARTITIONS, -(-left.count() // shard)))
    closed = left.repartitionByRange(again, "doc_id", "start_token").sortWithinPartitions("doc_id", "start_token").mapInArrow(_pack_task(capacity, shard, "r"), _OUT)
    return packed.filter(~loose).unionByName(closed)
