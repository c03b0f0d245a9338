import random

import pytest

import plotwright.llm.canonical as cn
from tests.fixtures import as_set, listing, rows

TOWNS = [(1, "Tłunybrowa"), (2, "Nowa Łęrzeczyce"), (3, "Czaczaszów Górna"), (4, "Mała Drawębrowa"), (5, "Huta"), (6, "Prupatyń")]


def ref(spark, names=TOWNS):
    return rows(spark, "loc_id bigint, name string", *({"loc_id": i, "name": n} for i, n in names))


def distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_automaton_agrees_with_edit_distance(k):
    rng = random.Random(k)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    trie = cn.Trie()
    for i, n in enumerate(names):
        trie.add(n, i)
    for _ in range(150):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8)))
        assert trie.search(w, k) == {i: d for i, n in enumerate(names) if (d := distance(w, n)) <= k}, w


CASES = {
    "TŁUNYBROWA": 1, "tlunybrowa": 1, "m. Tłunybrowa": 1, "miasto Tłunybrowa": 1, "43-176 Tłunybrowa": 1, "Tłunyborwa": 1, "Tłunybrowa, śląskie": 1, "Tłunybrowa /śląsk/": 1,
    "TÅ‚unybrowa": 1, "Tłunybrowa i okolice": 1, "Tłunybrowa.": 1, " Tłunybrowa": 1, "Huta Dolna, Tłunybrowa": 1, "Tłunybrowa (Łąki)": 1, "Tłunybrowa - Nowe Osady": 1, "Tłunybrowa, gm. Prupatyń": 1,
    "N. Łęrzeczyce": 2, "nowa-łęrzeczyce": 2, "Nowa  Łęrzeczyce": 2, "Łęrzeczyce Nowa": 2, "Czaczaszów G.": 3, "M. Drawębrowa": 4, "gm. Prupatyń": 6, "gm. Prupatyń - Osada": 6,
    "Jasiechonburg": 0, "Jasiechonburg, gm. Prupatyń": 0, "centrum": 0, "-": 0, "???": 0, "woj. śląskie": 0, "x" * 20_000: 0, "hota": 0,
}


def test_spellings(spark):
    df = listing(spark, *({"locality": v, "district": "Osada"} for v in CASES))
    got = {r["locality"]: r["loc_id"] for r in cn.map_to_canonical(df, "locality", ref(spark), beside="district").collect()}
    assert got == CASES


def test_blank_exact_and_repeated_values(spark):
    df = listing(spark, *({"locality": v} for v in (None, "", "   ", chr(0xA0), "Tłunybrowa", "tłunybrowa", "tłunybrowa")))
    assert as_set(cn.map_to_canonical(df, "locality", ref(spark)).select("seq", "loc_id")) == {(6, 1), (7, 1)}


def test_empty_tables_and_clashing_columns(spark):
    assert cn.map_to_canonical(listing(spark), "locality", ref(spark)).count() == 0
    df = rows(spark, "seq bigint, locality string, loc_id string, value int, n int, entry int", {"seq": 1, "locality": "tłunybrowa", "loc_id": "old", "value": 1})
    assert as_set(cn.map_to_canonical(df, "locality", ref(spark)).select("seq", "loc_id", "value")) == {(1, 1, 1)}
    assert as_set(cn.map_to_canonical(df, "locality", ref(spark, [])).select("loc_id")) == {(0,)}
    assert as_set(cn.map_to_canonical(df, "locality", ref(spark, [(1, None)])).select("loc_id")) == {(0,)}


def test_long_reference_lists_are_searched_in_blocks(spark):
    df = listing(spark, *({"locality": v} for v in CASES))
    whole = cn.build_value_dictionary(df, "locality", ref(spark), "loc_id", "name", ["Osada"])
    parts = cn.build_value_dictionary(df, "locality", ref(spark), "loc_id", "name", ["Osada"], block=2)
    assert as_set(whole.select("value", "entry")) == as_set(parts.select("value", "entry"))


def test_blocks_keep_reading_order_spelling_and_municipalities(spark):
    # Two entries that fall into different blocks; the answer is that of the whole list.
    names = [(5, "Huta Dolna"), (1, "Prupatyń")]
    values = ("Huta Dolna, Prupatyń", "Huta Dolna, gm. Prupatyń", "huta dolna (prupatyn)", "Hutta Dolna, Prupatyn", "gm. Prupatyń, Nieznana")
    df = listing(spark, *({"locality": v} for v in values))
    for block in (cn.BLOCK, 1):
        d = cn.build_value_dictionary(df, "locality", ref(spark, names), "loc_id", "name", [], block)
        assert {r["value"]: r["entry"] for r in d.collect()} == {values[0]: 5, values[1]: 5, values[2]: 5, values[3]: 1, values[4]: 0}, block


def test_rare_districts_are_known(spark):
    many = [{"locality": "Tłunybrowa", "district": "Osada"}] * 1500
    df = listing(spark, *many, {"locality": "gm. Prupatyń, Zakątek Dolny", "district": "Zakątek Dolny"}, {"locality": "Rzadka / gm. Prupatyń", "district": None}, {"locality": "Nieznana, gm. Prupatyń", "district": "Osada"}, {"locality": None, "district": "rzadka"})
    for block in (cn.BLOCK, 2):
        d = cn.build_value_dictionary(df, "locality", ref(spark), "loc_id", "name", cn.district_segments(df, "district"), block)
        assert as_set(d.select("value", "entry")) == {("gm. Prupatyń, Zakątek Dolny", 6), ("Rzadka / gm. Prupatyń", 6), ("Nieznana, gm. Prupatyń", 0)}
    assert as_set(cn.map_to_canonical(df, "locality", ref(spark), beside="district").select("locality", "loc_id")) == as_set(d.select("value", "entry"))
