"""Freely typed values mapped to a canonical list: a trie searched with a Levenshtein automaton.

The reference names and their alias paths (a qualifying word in front or behind, written out or
as an initial) form a trie over folded text. A value is cut into segments, stripped of what
stands beside a name, and each segment is searched: the automaton reads the trie and keeps
every entry within the distance that the segment's length allows (insertions, deletions,
substitutions, swaps of neighbours). Values are deduplicated first; the searches run once per
distinct value and the results are joined back.

Defined results
---------------
* null or blank (all kinds of white space) values and values that are exactly a reference name: no row.
* values that name no entry: ``0``. Ties in distance: the entry with the nearer unfolded spelling, then the smaller id.
* values of any length are read whole; repeated rows keep their rows; an empty table gives an empty
  result; an empty reference list reports every value as 0. Null reference names are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import BLANKS, fold_py
from plotwright.operators.skew import lookup_join
from plotwright.session import materialize, ship_code

# Qualifying words of town names, which may be shortened to an initial.
QUALIFIERS = ("nowa", "nowe", "nowy", "stara", "stare", "stary", "gorna", "gorne", "gorny", "dolna", "dolne", "dolny", "mala", "male", "maly", "wielka", "wielkie", "wielki")
# Words that stand beside a town name without being part of it.
TOWN_WORDS = ("m", "miasto", "miejscowosc", "wies")
OUTER_WORDS = ("gm", "gmina", "pow", "powiat")
REGION_WORDS = ("woj", "wojewodztwo")
TAIL_WORDS = ("i", "okolice", "okolica", "slaskie", "slask", "sl", "polska", "centrum")
#: Entries of the reference list that one trie holds; longer lists are searched block by block.
BLOCK = 100_000


class Automaton:
    """Lazily determinised Levenshtein automaton for at most ``k`` edits, shared by all words.

    A state is a set of (characters consumed, edits, swap pending) relative to its smallest
    position; its successor depends only on which of the next ``2k + 2`` characters equal the
    one read, so transitions are memoised across words.
    """

    def __init__(self, k: int) -> None:
        self.k, self.width, self.memo = k, 2 * k + 2, {}
        self.start = ((0, 0, 0),)

    def step(self, state, base: int, mask: int, left: int):
        """State after one more character; ``mask``: where it occurs in the word from ``base``; ``left``: characters from ``base`` on."""
        window = (mask >> base) & ((1 << self.width) - 1)
        key = (state, window, min(left, self.width))
        found = self.memo.get(key)
        if found is None:
            found = self.memo[key] = self._derive(state, window, min(left, self.width))
        return found

    def _derive(self, state, window: int, left: int):
        k, out = self.k, set()
        for i, e, swap in state:
            if swap:
                if window >> i & 1:
                    out.add((i + 2, e, 0))
                continue
            for d in range(k - e + 1):
                if i + d < left and window >> (i + d) & 1:
                    out.add((i + d + 1, e + d, 0))
            if e < k:
                out.add((i, e + 1, 0))
                if i < left:
                    out.add((i + 1, e + 1, 0))
                if i + 1 < left and window >> (i + 1) & 1:
                    out.add((i, e + 1, 1))
        kept = {p for p in out if not any(q is not p and q[2] == 0 and q[1] < p[1] and abs(q[0] - p[0]) <= p[1] - q[1] and p[2] == 0 for q in out)}
        if not kept:
            return 0, ()
        shift = min(p[0] for p in kept)
        return shift, tuple(sorted((i - shift, e, s) for i, e, s in kept))

    def distance(self, state, left: int) -> int:
        """Edits when the word ends ``left`` characters after the state's base, or more than ``k``."""
        return min((e + left - i for i, e, s in state if not s and i <= left), default=self.k + 1)


class Trie:
    """Reference entries by folded spelling; ``terminal[node]`` holds the ids ending there."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.terminal: dict[int, set[int]] = defaultdict(set)
        self.automata: dict[int, Automaton] = {}

    def add(self, text: str, entry: int) -> None:
        at = 0
        for ch in text:
            nxt = self.children[at].get(ch)
            if nxt is None:
                nxt = self.children[at][ch] = len(self.children)
                self.children.append({})
            at = nxt
        self.terminal[at].add(entry)

    def exact(self, text: str) -> set[int]:
        at = 0
        for ch in text:
            at = self.children[at].get(ch, -1)
            if at < 0:
                return set()
        return self.terminal.get(at, set())

    def search(self, text: str, k: int) -> dict[int, int]:
        """All entries within ``k`` edits of ``text`` with their distance."""
        auto = self.automata.get(k) or self.automata.setdefault(k, Automaton(k))
        masks: dict[str, int] = {}
        for i, ch in enumerate(text):
            masks[ch] = masks.get(ch, 0) | 1 << i
        n, found, stack = len(text), {}, [(0, 0, auto.start)]
        children, terminal = self.children, self.terminal
        while stack:
            node, base, state = stack.pop()
            if node in terminal:
                d = auto.distance(state, n - base)
                if d <= k:
                    for x in terminal[node]:
                        found[x] = min(d, found.get(x, d))
            for ch, child in children[node].items():
                shift, following = auto.step(state, base, masks.get(ch, 0), n - base)
                if following:
                    stack.append((child, base + shift, following))
        return found


def allowed_edits(length: int) -> int:
    """Edits allowed for a folded text of ``length`` characters."""
    return 0 if length < 5 else 1 if length < 9 else 2


def aliases(name: str) -> set[str]:
    """Folded spellings of a reference name: as it is, and with a qualifier moved or shortened."""
    words = re.sub(r"[^a-z0-9]+", " ", fold_py(name)).split()
    out = {" ".join(words)}
    for at in (0, len(words) - 1) if len(words) > 1 else ():
        if words[at] in QUALIFIERS:
            rest = words[1:] if at == 0 else words[:-1]
            for q in (words[at], words[at][0]):
                out |= {" ".join([q, *rest]), " ".join([*rest, q])}
    return out


def repair(text: str) -> str:
    """Text whose UTF-8 bytes were once read as a Windows code page, made readable again."""
    if not re.search("[ÃÄÅĂĹâ]", text):
        return text
    raw = bytearray()
    for ch in text:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return text
            raw.append(ord(ch))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return text


def segments(value: str) -> list[tuple[str, str, bool]]:
    """Candidate names of a value in reading order: (folded text, the same without what stands beside a name, names an outer unit)."""
    text = re.sub(f"[{BLANKS}]+", " ", repair(value))
    text = re.sub(r"\b\d{2}-?\d{3}\b-?", " ", fold_py(text))
    out = []
    for part in re.split(r"[,;()/|]| -+ |-{2,}|^ *-+|-+ *$", text):
        words = re.sub(r"[^a-z0-9]+", " ", part).split()
        whole, outer = " ".join(words), False
        while len(words) > 1 and words[0] in TOWN_WORDS + OUTER_WORDS:
            outer |= words[0] in OUTER_WORDS
            words = words[1:]
        words = words[: next((i for i, w in enumerate(words) if w in REGION_WORDS), len(words))]
        while words and words[-1] in TAIL_WORDS:
            words = words[:-1]
        if words and not (len(words) == 1 and words[0].isdigit()):
            out.append((whole, " ".join(words), outer))
    return out


class Resolver:
    """Finds the reference entry a value stands for; ``0`` if none."""

    def __init__(self, names: list[tuple[int, str]]) -> None:
        self.trie, self.names, self.cache = Trie(), dict(names), {}
        for entry, name in names:
            for alias in aliases(name):
                self.trie.add(alias, entry)

    def hit(self, whole: str, bare: str) -> tuple[int, int, int, int]:
        """(way, edits, spelling, entry) of one segment, the smallest of all entries near enough; entry 0 if there is none.

        ``way``: 0 the whole segment is an entry, 1 it is one without what stands beside it, 2 found by search. The
        smallest of parts of the reference list is the smallest of the whole list.
        """
        found = self.cache.get((whole, bare))
        if found is None:
            for way, near in enumerate((self.trie.exact(whole), self.trie.exact(bare), None)):
                near = self.trie.search(bare, allowed_edits(len(bare))) if near is None else dict.fromkeys(near, 0)
                if near:
                    break
            found = self.cache[(whole, bare)] = min(((way, d, self._spelling(whole, x), x) for x, d in near.items()), default=(9, 99, 0, 0))
            if len(self.cache) > 500_000:
                self.cache.clear()
        return found

    def name(self, whole: str, bare: str) -> tuple[int, int]:
        """(edits, entry) of one segment."""
        _, edits, _, entry = self.hit(whole, bare)
        return edits, entry

    def _spelling(self, text: str, entry: int) -> int:
        name = self.names[entry].lower()
        return sum(a != b for a, b in zip(text, name)) + abs(len(text) - len(name))

    def value(self, value: str, beside) -> int:
        """Entry of a whole value. A name marked as a municipality counts only if nothing but names in ``beside`` (districts) stands with it."""
        parts = segments(value)
        best = lambda outer: min((h for h in (self.name(w, b) for w, b, o in parts if o == outer) if h[1]), key=lambda h: h[0], default=(99, 0))[1]
        own, outer = best(False), best(True)
        return outer if not own and outer and all(b in beside for _, b, o in parts if not o) else own


def district_segments(rows: DataFrame, column: str) -> DataFrame:
    """``segment``: every distinct name of the values of ``column``, as :func:`segments` reads them."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s for v in b["value"].to_pylist() for _, s, _ in segments(v)], pa.string())], names=["segment"])

    ship_code(rows.sparkSession)
    return rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().mapInArrow(run, "segment string").distinct()


def reference_names(reference: DataFrame, ref_id: str, ref_name: str) -> DataFrame:
    """``entry, name`` of a reference list."""
    return reference.filter(F.col(ref_name).isNotNull()).select(F.col(ref_id).alias("entry"), F.col(ref_name).alias("name"))


def resolve_values(values: DataFrame, names: DataFrame, districts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``value, n, entry, other`` of ``values`` (``value, n``): the entry of ``names`` meant or 0, and if 0 the first name in the value that is no district.

    A reference list of more than ``block`` names is searched block by block. Blocks return the best hit of every
    segment; the value is judged once, after the hits are brought together, so blocks change no answer.
    """
    blocks = max(1, -(-names.count() // block))
    found = None
    for b in range(blocks):
        part = names if blocks == 1 else names.filter(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == b)
        listed = [(r["entry"], r["name"]) for r in part.collect()]  # at most about `block` entries
        # Searching costs more than moving the distinct values, so they are dealt out evenly.
        own = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_matcher(listed), "value string, n bigint, hits array<struct<way: int, edits: int, spelling: int, entry: bigint>>, parts array<string>, outer array<boolean>")
        found = own if found is None else found.unionByName(own)
    if blocks > 1:
        found = found.groupBy("value").agg(F.max("n").alias("n"), F.collect_list("hits").alias("lists"), F.max("parts").alias("parts"), F.max("outer").alias("outer"))
        found = found.withColumn("hits", F.transform(F.get("lists", F.lit(0)), lambda h, i: F.array_min(F.transform("lists", lambda one: F.get(one, i)))))

    def best(outer: bool) -> Column:
        placed = F.transform("hits", lambda h, i: F.struct(h["edits"].alias("edits"), i.alias("at"), h["entry"].alias("entry"), F.get("outer", i).alias("outer")))
        return F.coalesce(F.array_min(F.filter(placed, lambda h: (h["entry"] != 0) & (h["outer"] == F.lit(outer))))["entry"], F.lit(0))

    others = F.filter("parts", lambda p, i: ~F.get("outer", i))
    found = materialize(found.select("value", "n", best(False).alias("own"), best(True).alias("outer_entry"), others.alias("others")), "readings")
    sure = found.filter("own != 0").select("value", "n", F.col("own").alias("entry"), F.lit(None).cast("string").alias("other"))
    # Few values have no name of their own; what they have is looked up among all districts.
    open_ = found.filter("own = 0")
    unknown = open_.select("value", F.posexplode("others").alias("at", "segment")).join(districts, "segment", "left_anti").groupBy("value").agg(F.min(F.struct("at", "segment"))["segment"].alias("other"))
    judged = open_.join(unknown, "value", "left").select("value", "n", F.when(F.col("other").isNull(), F.col("outer_entry")).otherwise(F.lit(0)).cast("bigint").alias("entry"), "other")
    return sure.unionByName(judged)


def build_value_dictionary(rows: DataFrame, column: str, reference: DataFrame, ref_id: str, ref_name: str, beside: list[str] | DataFrame = (), block: int = BLOCK) -> DataFrame:
    """``value, entry, n``: each distinct non-blank value of ``column`` that is not exactly a name, with its entry or 0.

    ``beside``: values, or a table of :func:`district_segments`, that may stand beside a municipality.
    """
    values = rows.filter(F.regexp_replace(column, f"[{BLANKS}]+", "") != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    names = reference_names(reference, ref_id, ref_name)
    values = values.join(names.select(F.col("name").alias("value")), "value", "left_anti")
    if not isinstance(beside, DataFrame):
        beside = rows.sparkSession.createDataFrame([(s,) for s in {s for v in beside for _, s, _ in segments(v)}], "segment string")
    return materialize(resolve_values(values, names, beside, block).select("value", "entry", "n"), "canonical")


def _matcher(listed: list[tuple[int, str]]):
    kind = pa.list_(pa.struct([("way", pa.int32()), ("edits", pa.int32()), ("spelling", pa.int32()), ("entry", pa.int64())]))

    def run(batches):
        resolver = Resolver(listed)
        for b in batches:
            parts = [segments(v) for v in b["value"].to_pylist()]
            hits = [[dict(zip(("way", "edits", "spelling", "entry"), resolver.hit(w, s))) for w, s, _ in p] for p in parts]
            yield pa.RecordBatch.from_arrays([b["value"], b["n"], pa.array(hits, kind), pa.array([[s for _, s, _ in p] for p in parts], pa.list_(pa.string())), pa.array([[o for _, _, o in p] for p in parts], pa.list_(pa.bool_()))], names=["value", "n", "hits", "parts", "outer"])

    return run


def map_to_canonical(rows: DataFrame, column: str, reference: DataFrame, ref_id: str = "loc_id", ref_name: str = "name", beside: str | None = None) -> DataFrame:
    """``rows`` whose ``column`` is neither blank nor exactly a name, with the entry meant in ``ref_id`` (0: none).

    ``beside`` names a column (districts) whose values may stand beside the name, however rare they are.
    """
    d = build_value_dictionary(rows, column, reference, ref_id, ref_name, district_segments(rows, beside) if beside else ())
    keyed = rows.filter(F.col(column).isNotNull()).withColumn("__value", F.col(column))
    d = d.select(F.col("value").alias("__value"), F.col("entry").alias("__entry"), F.col("n").alias("__n"))
    return lookup_join(keyed, d, ["__value"], "__n", ["__entry"]).withColumn(ref_id, F.col("__entry")).drop("__value", "__entry")
