import random

from pyspark.sql import functions as F

from plotwright.functions import addresses as A
from plotwright.functions import numbers as N
from plotwright.functions.photos import difference_hash, hamming, limbs_of_decimal, same_photos
from plotwright.functions.text import fold_py


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_numbers(spark):
    nb = chr(0xA0)
    assert column(spark, ["1 234,5", f"99{nb}000 zł", "", None, "abc", "-3,5", "1.2.3"], N.to_float) == [1234.5, 99000.0, None, None, None, -3.5, None]
    assert column(spark, ["2,5", "3,5", "0,4", "x"], N.to_int) == [2, 4, 0, None]
    assert column(spark, ["1 250 000 zł za całość 5", "Zapytaj", None], N.price_before_unit) == [1250000, None, None]
    assert column(spark, ["THREE", " two ", "4", "many", "", None], N.rooms_from_word) == [3, 2, 4, None, None, None]
    assert column(spark, ["parter", "Suterena", "poddasze", "> 10", "-1", "FIRST", "3", None], N.floor_number) == [0, -1, None, 10, -1, None, 3, None]
    assert column(spark, ["3.9", "-3.9", "x", None], N.truncated_int) == [3, -3, None, None]
    assert column(spark, [50.0, 50.009, 50.02, None], N.has_decimals, "double") == [False, False, True, None]
    assert column(spark, [204.0, 10.126, None], N.area_key, "double") == [20400, 1013, None]
    assert column(spark, [2.5, 3.5], N.area_bucket, "double") == [2, 4]


def test_photos(spark):
    a, b = limbs_of_decimal(2**255 + 3), limbs_of_decimal(5)
    assert all(-(2**63) <= x < 2**63 for x in a)
    df = spark.createDataFrame([([a], [b], []), ([limbs_of_decimal(2**41 - 1)], [limbs_of_decimal(0)], None), ([limbs_of_decimal(2**40 - 1)], [limbs_of_decimal(0)], None)], "a array<array<bigint>>, b array<array<bigint>>, c array<array<bigint>>")
    got = df.select(hamming(F.get("a", F.lit(0)), F.get("b", F.lit(0))), same_photos(F.col("a"), F.col("b")), same_photos(F.col("a"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(3, True, False), (41, False, False), (40, True, False)]
    rng = random.Random(1)
    grey = [rng.randrange(256) for _ in range(17 * 16)]
    want = sum(1 << (y * 16 + x) for y in range(16) for x in range(16) if grey[y * 17 + x] < grey[y * 17 + x + 1])
    assert spark.createDataFrame([(grey,)], "g array<int>").select(difference_hash(F.col("g"))).first()[0] == limbs_of_decimal(want)


def slow_equal(a, b):
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    n = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return n >= 4 and n >= len(short) - 1 and len(long) - n <= 3


def slow_street(a, b):
    ta, tb = ([t for t in "".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in fold_py(s)).split() if t not in A.STREET_NOISE and not t.isdigit()] for s in (a, b))
    if not ta or not tb:
        return False
    few, many = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
    return slow_equal(few[-1], many[-1]) and all(any(slow_equal(t, u) for u in many) for t in few[:-1])


def test_streets(spark):
    rng = random.Random(2)
    stems = ["Gdańsk", "Gdyńsk", "Mickiewicz", "Kościuszk", "Polna", "15 Maj", "Jan", "Lip"]
    names = [" ".join(rng.choice(["ul. ", "", "os. "]) + rng.choice(stems) + rng.choice(["", "a", "ą", "iej", "owska", "i"]) for _ in range(rng.randrange(1, 4))) for _ in range(70)] + ["", "12", "ul."]
    pairs = [(a, b) for a in names for b in names]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", A.streets_agree(F.col("a"), F.col("b")).alias("s"))
    got = {(r["a"], r["b"]): r["s"] for r in df.collect()}
    assert got == {p: slow_street(*p) for p in pairs}
    assert column(spark, ["ul. Gdańską 5", None], lambda c: A.streets_agree(c, F.lit("Gdańska"))) == [True, False]


def test_places_and_register_fields(spark):
    assert column(spark, ["Krótka, Stare Miasto, Gliwniki Łabędy, śląskie", "Zabrów", "", None], lambda c: A.town_of_place(c, cities=("Gliwniki",))) == ["Gliwniki", "Zabrów", None, None]
    assert column(spark, ["a, b, c", "a", None], A.district_of_place) == ["a, b", None, None]
    assert column(spark, ["x 2024.05.06 y", "2024-05-06", None], A.dotted_date) == ["2024-05-06", None, None]
    assert column(spark, ["MSC:A;UL:B: c;NR_PORZ:", "", None], lambda c: A.register_field(c, "UL")) == ["B: c", None, None]
    assert column(spark, ["MSC:A;UL:B;NR_PORZ:", "UL:x"], lambda c: A.register_field(c, "NR_PORZ")) == [None, None]
    assert column(spark, ["1_4.5.6_BUD.2_LOK", "1.2", "", None], A.parcel_of_unit) == ["1_4.5.6", "1.2", None, None]
    assert column(spark, ["12 A", "12a", None], lambda c: A.numbers_agree(c, F.lit("12A"))) == [True, True, False]
    assert column(spark, ["Huta", "Inne"], lambda c: A.merged_town(c, ["Huta"], "Miasto")) == ["Miasto", "Inne"]


def test_distances(spark):
    df = spark.createDataFrame([(50.0, 19.0), (51.0, 19.0)], "a double, b double").select(N.haversine_km(F.lit(50.0), F.lit(19.0), F.col("a"), F.col("b")), N.in_box(F.col("a"), F.col("b"), 50.0, 19.0, 0.5))
    assert [tuple(r) for r in df.collect()] == [(0, True), (111, False)]
