"""Near-duplicate listings: banded MinHash candidates, odd sketches, exact verification.

1. Rows that agree in type, area, price, word set and picture form one class; classes are
   compared, members are expanded at the end, so copies cost nothing in the search.
2. Classes are sent to the cells of a grid over type, log area and log price. A class near the
   upper edge of its cell also goes to the next one, so no pair that is close enough in area and
   price is separated; a pair that meets twice is taken in the lower cell only. The grid gets
   finer as the fullest cell grows. A cell of the finest grid is one task up to ``CROWD * BLOCK`` classes,
   which it holds with their band keys; in fuller ones classes meet by (cell, band key), which sends each class once for each key.
3. In a task, each class gets ``samples`` MinHash values of its title words; groups of ``ROWS``
   values are bands, and classes that share a band (or the picture file) are candidates.
4. All samples are folded into an odd sketch: sample i toggles one of ``bits`` parity bits.
   The population count of the XOR of two sketches estimates how many samples differ, sharply
   so for high similarities; candidates clearly below the threshold go.
5. The rest is verified exactly: area, price, and equal pictures or shared words.

Recall of step 3 for titles that share exactly the threshold of 60 % is 1 - (1 - 0.6^2)^bands:
99.9 % at 16 bands, above 99.999 % at 75 %; step 4 keeps 4 standard deviations. Equal pictures
are found without loss.

Defined results
---------------
* null, zero, negative or not finite area or price, null type: the row has no partner.
* null or empty titles share no words; two empty titles are not alike. Titles of any length count whole.
* repeated rows are partners of each other. Empty tables give empty results.
* columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import fold_words
from plotwright.llm.pairs import expand_pairs
from plotwright.session import materialize, spread

SAMPLES, BITS, BANDS, ROWS = 128, 512, 16, 2
#: Classes of the fullest cell up to which wider cells are taken.
BLOCK = 4096
#: Times ``BLOCK`` that a cell may hold with the copies of its neighbours' classes; a fuller one is crowded.
CROWD = 64
#: Sets whose MinHash samples, and pairs of one key, that a task holds at a time.
SETS, PAIRS = 16_384, 500_000
#: Cell widths tried, in tolerances, widest first: wide cells copy fewer rows, narrow ones compare fewer.
CELLS = (8, 4, 2, 1)


def picture_file(image: Column) -> Column:
    """The file an image address shows, whatever host, size or format; null for stand-ins."""
    bare = F.regexp_replace(F.lower(F.trim(image)), r"(?:[?#;].*|/image(?:[?#;].*)?)$", "")
    stem = F.regexp_extract(bare, r"([^/]+?)(?:[_-](?:xs|s|m|l|xl|xxl|thumb|\d{2,4}x\d{2,4}|\d{1,2}))*(?:\.[a-z]{3,4})?$", 1)
    return F.when(~bare.rlike(r"placeholder|brak[-_]?zdj|no[-_]?(?:photo|image|img|pic)|default|blank|noimg") & (stem != ""), stem)


def sketch_limit(min_share: float, samples: int, bits: int, deviations: float = 4.0) -> int:
    """Largest XOR population count that still can mean a share of ``min_share``."""
    differ = 2 * samples * (1 - min_share)
    fill = np.exp(-2 * differ / bits)
    sampling = 2 * np.sqrt(samples * min_share * (1 - min_share)) * fill
    throwing = np.sqrt(bits / 4 * (1 - fill**2) * fill)
    return int(np.ceil(bits / 2 * (1 - fill) + deviations * np.hypot(sampling, throwing)))


class OddSketcher:
    """MinHash samples of word sets and their odd sketches, for arrays of sets at once."""

    def __init__(self, samples: int = SAMPLES, bits: int = BITS) -> None:
        rng = np.random.default_rng(20240229)
        self.samples, self.bits = samples, bits
        self.mult = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, samples, dtype=np.uint64)

    def minhash(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``samples`` x sets; ``words`` holds the hashed words of all sets, set i from ``starts[i]`` on; no set is empty."""
        out = np.empty((self.samples, len(starts)), np.uint64)
        for i in range(self.samples if len(starts) else 0):
            h = (words ^ self.salt[i]) * self.mult[i]
            h ^= h >> np.uint64(32)
            out[i] = np.minimum.reduceat(h * self.mult[-1 - i], starts)
        return out

    def sketch(self, mins: np.ndarray) -> np.ndarray:
        """Sets x ``bits / 64`` words of parity bits."""
        out, row = np.zeros((mins.shape[1], self.bits // 64), np.uint64), np.arange(mins.shape[1])
        for i in range(self.samples):
            spot = (mins[i] * self.mult[i]) >> np.uint64(64 - (self.bits - 1).bit_length())
            out[row, (spot >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (spot & np.uint64(63))
        return out


def equal_pairs(keys: np.ndarray, at: np.ndarray, limit: int = 4_000_000):
    """Pairs (i, j) of ``at`` whose keys agree, in arrays of about ``limit`` at most."""
    order = np.argsort(keys, kind="stable")
    k, ids = keys[order], at[order]
    bounds = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
    size = np.diff(bounds)
    first, n = bounds[:-1][size > 1], size[size > 1]
    if not len(n):
        return
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    spots, ahead = np.repeat(first, n) + inside, np.repeat(n, n) - 1 - inside
    reached, done = np.cumsum(ahead), 0
    while done < len(spots):
        before = int(reached[done - 1]) if done else 0
        cut = max(done + 1, int(np.searchsorted(reached, before + limit, "right")))
        rep = ahead[done:cut]
        total = int(rep.sum())
        if total:
            i = np.repeat(spots[done:cut], rep)
            yield ids[i], ids[i + 1 + np.arange(total) - np.repeat(np.cumsum(rep) - rep, rep)]
        done = cut


def _shared(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of common words of the sets a[k] and b[k]; each set's words are sorted."""
    n = ends - starts
    out = np.zeros(len(a), np.int64)
    longest = np.maximum(n[a], n[b])
    short = np.flatnonzero(longest <= 48)
    for part in np.array_split(short, max(1, len(short) // 20_000)):
        if not len(part):
            continue
        width = int(longest[part].max())
        grid = lambda s, pad: np.where(np.arange(width) < n[s][:, None], words[np.minimum(starts[s][:, None] + np.arange(width), max(len(words) - 1, 0))], pad + np.arange(width, dtype=np.uint64))
        both = np.sort(np.concatenate([grid(a[part], np.uint64(0)), grid(b[part], np.uint64(2**32))], axis=1), axis=1)
        out[part] = (both[:, 1:] == both[:, :-1]).sum(axis=1)
    for k in np.flatnonzero(longest > 48):
        out[k] = len(np.intersect1d(words[starts[a[k]] : ends[a[k]]], words[starts[b[k]] : ends[b[k]]], assume_unique=True))
    return out


def band_key(mins: np.ndarray, k: int) -> np.ndarray:
    """Key of band ``k`` of each set."""
    key = mins[ROWS * k]
    for extra in mins[ROWS * k + 1 : ROWS * (k + 1)]:
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + extra
    return key


def _signatures(column, sketcher: OddSketcher, bands: int):
    """(words of all rows, starts, ends, rows with words, bands x these: band keys, their odd sketches) of a column of word lists."""
    listed = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
    offsets = listed.offsets.to_numpy()
    words = listed.values.to_numpy(zero_copy_only=False).view(np.uint64)
    starts, ends = offsets[:-1], offsets[1:]
    full = np.flatnonzero(ends > starts)
    keys, sketch = np.empty((bands, len(full)), np.uint64), np.empty((len(full), sketcher.bits // 64), np.uint64)
    for at in range(0, len(full), SETS):  # the samples of all sets would take more room than the sets
        part = full[at : at + SETS]
        mins = sketcher.minhash(words[starts[part[0]] : ends[part[-1]]], starts[part] - starts[part[0]])
        sketch[at : at + SETS] = sketcher.sketch(mins)
        for k in range(bands):
            keys[k, at : at + SETS] = band_key(mins, k)
    return words, starts, ends, full, keys, sketch


def _sketch_task(bands: int, samples: int, bits: int):
    """Band keys and odd sketch of each class, in place of its words; null for a class without words."""

    def run(batches):
        sketcher = OddSketcher(samples, bits)
        for b in batches:
            if not b.num_rows:
                continue
            _, _, _, full, banded, sketched = _signatures(b["words"], sketcher, bands)
            keys, sketch = [None] * b.num_rows, [None] * b.num_rows
            rows, held = np.ascontiguousarray(banded.T).view(np.int64), sketched.view(np.int64)
            for j, i in enumerate(full):
                keys[i], sketch[i] = rows[j], held[j]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("id", "type", "area", "price", "picture")), pa.array(keys, longs), pa.array(sketch, longs)], names=["id", "type", "area", "price", "picture", "keys", "sketch"])

    return run


def _cell_task(area_tol: float, price_tol: float, min_share: float, bands: int, samples: int, bits: int):
    """The pairs of close classes among the rows of one cell."""
    sketcher, limit = OddSketcher(samples, bits), sketch_limit(min_share, samples, bits)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, area, price = (t[c].to_numpy() for c in ("id", "area", "price"))
        copy, picture = t["copy"].to_numpy(), t["picture"].to_numpy(zero_copy_only=False)
        words, starts, ends, full, keys, sketched = _signatures(t["words"], sketcher, bands)
        sketch = np.zeros((len(ids), bits // 64), np.uint64)
        sketch[full] = sketched

        def close(a, b):
            m = (copy[a] & copy[b]) == 0  # both copied in one direction: the pair also meets in the lower cell
            m &= np.abs(area[a] - area[b]) <= area_tol * np.maximum(area[a], area[b]) + 1e-9
            m &= np.abs(price[a] - price[b]) <= price_tol * np.maximum(price[a], price[b]) + 1e-9
            return a[m], b[m]

        kept, n = [], len(ids)
        shown = np.flatnonzero(picture != 0)
        for a, b in equal_pairs(picture[shown], shown, PAIRS):
            a, b = close(a, b)
            kept.append(np.minimum(a, b) * n + np.maximum(a, b))
        likely, held = [], 0
        for k in range(bands):
            for a, b in equal_pairs(keys[k], full, PAIRS):
                a, b = close(a, b)
                m = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= limit
                likely.append(np.minimum(a, b)[m] * n + np.maximum(a, b)[m])
                held += len(likely[-1])
                if held > 4_000_000:  # bands repeat each other's pairs; there are at most block ** 2 different ones
                    likely = [np.unique(np.concatenate(likely))]
                    held = 0
        if likely:
            pairs = np.unique(np.concatenate(likely))
            a, b = pairs // n, pairs % n
            common = _shared(words, starts, ends, a, b)
            union = (ends - starts)[a] + (ends - starts)[b] - common
            kept.append(pairs[common >= min_share * union - 1e-9])
        pairs = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        a, b = ids[pairs // max(n, 1)], ids[pairs % max(n, 1)]
        return pa.table([np.minimum(a, b), np.maximum(a, b)], schema=schema)

    return run


def near_duplicate_classes(listing: DataFrame, area_tol: float = 0.02, price_tol: float = 0.06, min_share: float = 0.6, bands: int = BANDS, samples: int = SAMPLES, bits: int = BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links, members): ``a, b`` of near-duplicate classes of equal rows, and ``id, seq`` of the classes of several rows. No pair within a class is written."""
    words = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(fold_words(F.coalesce("title", F.lit(""))), " "), lambda w: w != ""), lambda w: F.xxhash64(w))))
    rows = listing.filter((F.col("area") > 0) & (F.col("area") < float("inf")) & (F.col("price") > 0) & F.col("type").isNotNull()).select(
        "seq", F.xxhash64("type").alias("type"), F.col("area").cast("double").alias("area"), F.col("price").cast("double").alias("price"),
        words.alias("words"), F.coalesce(F.xxhash64(F.coalesce(picture_file(F.col("image")), F.lit(""))), F.lit(0)).alias("picture"),
    )
    stand_in = F.xxhash64(F.lit(""))
    rows = rows.withColumn("picture", F.when(F.col("picture") == stand_in, F.lit(0)).otherwise(F.col("picture"))).filter((F.size("words") > 0) | (F.col("picture") != 0))
    rows = materialize(rows.withColumn("k", F.struct(F.xxhash64("type", "area", "price", "words", "picture").alias("h"), F.xxhash64("picture", "words", "price", "area", "type").alias("g"))), "rows")
    reps = materialize(rows.groupBy("k").agg(F.min("seq").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    # Read several times; without the table each reading would join again.
    classes = materialize(rows.join(reps.select(F.col("id").alias("seq")), "seq", "left_semi").withColumnRenamed("seq", "id").drop("k"), "near-classes")
    links = _close_classes(classes, area_tol, price_tol, min_share, bands, samples, bits, block)
    members = materialize(rows.select("k", "seq").join(reps.filter("n > 1").select("k", "id"), "k").select("id", "seq"), "twins")
    return links, members


def near_duplicate_pairs(listing: DataFrame, area_tol: float = 0.02, price_tol: float = 0.06, min_share: float = 0.6, bands: int = BANDS, samples: int = SAMPLES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``seq_a, seq_b`` (seq_a < seq_b): every pair of near-duplicate rows. See the module text."""
    return expand_pairs(*near_duplicate_classes(listing, area_tol, price_tol, min_share, bands, samples, bits, block))


def _close_classes(classes: DataFrame, area_tol: float, price_tol: float, min_share: float, bands: int, samples: int, bits: int, block: int) -> DataFrame:
    steps = {"area": -float(np.log(1 - area_tol)) + 1e-7, "price": -float(np.log(1 - price_tol)) + 1e-7}
    fine = [F.floor(F.log(c) / s).alias(f"{c}_step") for c, s in steps.items()]
    # One row per occupied step of log area and log price: bounded by the range of the values, not by the number of rows.
    fullest = materialize(classes.select("type", *fine).groupBy("type", "area_step", "price_step").count(), "steps")
    width, most = CELLS[-1], 0
    for w in CELLS:
        cells = fullest.groupBy("type", F.floor(F.col("area_step") / w).alias("a"), F.floor(F.col("price_step") / w).alias("p")).agg(F.sum("count").alias("n"))
        most = cells.agg(F.max("n")).first()[0] or 0
        if most <= block:
            width = w
            break

    def place(c: str) -> Column:
        at = F.log(c) / (steps[c] * width)
        near_edge = at - F.floor(at) > 1 - 1 / width
        return F.when(near_edge, F.array(F.struct(F.floor(at).alias("cell"), F.lit(0).alias("copy")), F.struct((F.floor(at) + 1).alias("cell"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.floor(at).alias("cell"), F.lit(0).alias("copy"))))

    def placed(rows: DataFrame, *carried: str) -> DataFrame:
        return rows.withColumn("pa", F.explode(place("area"))).withColumn("pp", F.explode(place("price"))).select("id", "type", "area", "price", "picture", *carried, F.col("pa.cell").alias("ca"), F.col("pp.cell").alias("cp"), (F.col("pa.copy") + 2 * F.col("pp.copy")).cast("int").alias("copy"))

    cell = ["type", "ca", "cp"]
    sent = placed(classes, "words")
    crowded = materialize(placed(classes).groupBy(*cell).count().filter(F.col("count") > CROWD * block).select(*cell), "crowded")
    some = not crowded.isEmpty()
    found = (sent.join(crowded, cell, "left_anti") if some else sent).groupBy(*cell).applyInArrow(_cell_task(area_tol, price_tol, min_share, bands, samples, bits), "a bigint, b bigint")
    if not some:
        return found
    # Crowded cells: classes meet by (cell, band) or (cell, picture).
    in_crowd = placed(classes).join(crowded, cell, "left_semi").select("id").distinct()
    sketched = materialize(spread(classes.join(in_crowd, "id", "left_semi")).mapInArrow(_sketch_task(bands, samples, bits), "id bigint, type bigint, area double, price double, picture bigint, keys array<bigint>, sketch array<bigint>"), "sketches")
    crowd = placed(sketched, "keys", "sketch").join(crowded, cell, "left_semi")
    terms = F.concat(F.transform(F.coalesce("keys", F.array().cast("array<bigint>")), lambda k, i: F.xxhash64(*cell, i, k)), F.when(F.col("picture") != 0, F.array(F.xxhash64(*cell, F.lit("picture"), "picture"))).otherwise(F.array().cast("array<bigint>")))
    keyed = crowd.select("id", "area", "price", "copy", "picture", "sketch", F.explode(terms).alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    differ = sum((F.bit_count(F.get("x.sketch", F.lit(i)).bitwiseXOR(F.get("y.sketch", F.lit(i)))) for i in range(bits // 64)), F.lit(0))
    alike = lambda c, tol: F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) <= tol * F.greatest(f"x.{c}", f"y.{c}") + 1e-9
    seen = (F.col("x.picture") != 0) & (F.col("x.picture") == F.col("y.picture"))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.copy").bitwiseAND(F.col("y.copy")) == 0) & alike("area", area_tol) & alike("price", price_tol)
    met = x.hint("merge").join(y.hint("merge"), near & (seen | (differ <= sketch_limit(min_share, samples, bits)))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), seen.alias("seen"))
    pairs = materialize(met.groupBy("a", "b").agg(F.bool_or("seen").alias("seen")), "crowd-pairs")
    told = lambda c: classes.select(F.col("id").alias(c), F.col("words").alias(f"w_{c}"))
    common = F.size(F.array_intersect("w_a", "w_b"))
    worded = pairs.filter("not seen").join(told("a"), "a").join(told("b"), "b").filter(common >= min_share * (F.size("w_a") + F.size("w_b") - common) - 1e-9)
    return found.unionByName(pairs.filter("seen").select("a", "b")).unionByName(worded.select("a", "b"))
