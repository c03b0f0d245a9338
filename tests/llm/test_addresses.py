from plotwright.llm.addresses import AddressReader, grams, main_words, near, prefix, read_street, same_building_classes, same_building_pairs, same_street, town_grams
from tests.fixtures import as_set, listing, rows

TOWNS = [(1, "Tłunybrowa"), (2, "Prupatyń")]


def towns(spark, names=TOWNS):
    return rows(spark, "loc_id bigint, name string", *({"loc_id": i, "name": n} for i, n in names))


def test_reading():
    r, beside = AddressReader(TOWNS), {"ogrody", "stare miasto"}
    want = ("#1", "12", "klemensa ciszdogloba")
    for street, locality in (("ul. Klemensa Ciszdogłoba 12", "Tłunybrowa"), ("KLEMENSA CISZDOGŁOBA 12/4", "m. Tłunybrowa"), ("Ul.Klemensa Ciszdogłoba, 12", "Tłunyborwa"), ("12 al. Klemensa Ciszdogłoba", "40-123 Tłunybrowa"), ("Klemensa Ciszdogłoba nr 12 m. 5, Tłunybrowa", ""), ("Tłunybrowa, ul Klemensa Ciszdogłoba 12 lok. 3", None), ("Klemensa Ciszdogłoba, 12, Ogrody", "Tłunybrowa")):
        assert r.read(street, locality, "Ogrody", beside) == want, street
    assert r.read("ul. gen. X. Nowaka 3 B / 4", "Prupatyń", None) == ("#2", "3b", "x nowaka")
    assert r.read("15 Września 40", "Prupatyń", None) == ("#2", "40", "15 wrzesnia")
    assert r.read("15 Września", "Prupatyń", None) is None
    assert r.read("Nowaka 3", "Jasiechonburg", "Ogrody", beside) == ("jasiechonburg", "3", "nowaka")
    for street, locality in ((None, None), ("", ""), ("Nowaka", "Prupatyń"), ("Nowaka 3", None), ("12", "Prupatyń")):
        assert r.read(street, locality, None) is None


def test_names():
    same = lambda a, b: same_street(a, b, *(" ".join(w for w in x.split() if len(w) > 1 and w not in ("klemensa", "adama")) or x for x in (a, b)))
    assert same("klemensa ciszdogloba", "ciszdogloba")
    assert same("klemensa ciszdogloba", "k ciszdogloba")
    assert same("ciszdogloba klemensa", "klemensa ciszdolgoba")
    assert not same("klemensa ciszdogloba", "adama ciszdogloba")
    assert not same("klemensa ciszdogloba", "a ciszdogloba")
    assert not same("7 maja", "8 maja")
    assert near("abcd", "abdc", 1) and not near("abcd", "badc", 1)
    assert read_street("ul. 7 maja 148 mieszkanie 5") == (["7", "maja"], "148", True)


def test_main_words(spark):
    names = ("klemensa ciszdogloba", "klemensa wolskiego", "klemensa nowaka", "adama nowaka", "nowaka klemensa", "k nowaka", "klemensa", "7 maja", "polna", "osikeugorskiego klemensa")
    got = {r["name"]: r["main"] for r in main_words(rows(spark, "name string", *({"name": n} for n in names))).collect()}
    assert got == {"klemensa ciszdogloba": "ciszdogloba", "klemensa wolskiego": "wolskiego", "klemensa nowaka": "nowaka", "adama nowaka": "nowaka", "nowaka klemensa": "nowaka", "k nowaka": "nowaka", "klemensa": "klemensa", "7 maja": "7 maja", "polna": "polna", "osikeugorskiego klemensa": "osikeugorskiego klemensa"}


def test_a_given_name_alone_is_another_street_in_tables_of_any_size(spark):
    for others in (0, 9, 10):
        df = listing(spark, *({"street": s, "locality": "Tłunybrowa"} for s in ("Klemensa 5", "Klemensa Nowaka 5", "Nowaka 5", *(f"Klemensa Wzor{chr(97 + k % 26)}{chr(97 + k // 26)}skiego 7" for k in range(others)))))
        assert {p for p in as_set(same_building_pairs(df, towns(spark))) if max(p) <= 3} == {(2, 3)}, others


def test_rare_districts_are_known(spark):
    many = [{"street": "Polna 1", "locality": "Prupatyń", "district": "Osada"}] * 1200
    df = listing(spark, {"street": "Nowaka 3, Zakątek", "locality": "gm. Prupatyń, Zakątek"}, {"street": "Nowaka 3", "locality": "Prupatyń"}, {"street": None, "locality": None, "district": "Zakątek"}, *many)
    assert (1, 2) in as_set(same_building_pairs(df, towns(spark)))


def test_unlisted_towns_within_their_edits_share_an_index_term():
    idf = {}
    for a, b in (("jasiechonburg", "jasiechonbrug"), ("jasiechonburg", "jaseichonbrug"), ("dolina", "dloina"), ("abcd", "abcd"), ("wielkopol", "wielkopolka")):
        assert set(town_grams(a, idf)) & set(town_grams(b, idf)), (a, b)
    assert len(town_grams("jasiechonburgowo", idf)) == 7 and len(town_grams("abcd", idf)) == 1


def test_classes_hold_copies_without_their_pairs(spark):
    df = listing(spark, *[{"street": "Polna 1", "locality": "Prupatyń"}] * 200, {"street": "ul. Plona 1", "locality": "Prupatyń"})
    links, members = same_building_classes(df, towns(spark))
    assert as_set(links) == {(1, 201)} and members.count() == 200
    assert same_building_pairs(df, towns(spark)).count() == 200 * 201 // 2


def test_prefix_cannot_miss():
    v = {"a": 0.8, "b": 0.5, "c": (1 - 0.64 - 0.25) ** 0.5}
    assert prefix(v, 0.3) == ["a", "b", "c"] and prefix(v, 0.5) == ["a", "b"]


def test_pairs(spark):
    df = listing(
        spark,
        {"street": "ul. Nawochostkowa 81", "locality": "Tłunybrowa"},
        {"street": "NAWOCHOSTKOWA 81/3", "locality": "tłunybrowa", "district": "Ogrody"},
        {"street": "Nawochostkowa 81A", "locality": "Tłunybrowa"},
        {"street": "Nawohcostkowa 81, Tłunybrowa", "locality": None},
        {"street": "Nawochostkowa 81", "locality": "Prupatyń"},
        {"street": "ul. Nawochostkowa 81", "locality": "Tłunybrowa"},
        {"street": "Nawochostkowa 81", "locality": "Jasiechonburg"},
        {"street": "Nawochostkowa 81", "locality": "Jasiechonbrug"},
        {"street": "x" * 30_000 + " 81", "locality": "Tłunybrowa"},
        {},
    )
    same = (1, 2, 4, 6)
    assert as_set(same_building_pairs(df, towns(spark))) == {(a, b) for a in same for b in same if a < b} | {(7, 8)}
    assert same_building_pairs(listing(spark), towns(spark)).count() == 0
    assert as_set(same_building_pairs(df.limit(2), towns(spark, []))) == {(1, 2)}
