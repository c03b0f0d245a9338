"""Notarial deeds joined to properties: towns, area bands, date windows, scores, funnel."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plotwright.config import LIMITS
from plotwright.functions.addresses import parcel_of_unit, plain, register_field, street_words, streets_agree, word_lists_agree
from plotwright.functions.numbers import half_even, has_decimals, price_per_m2, truncated_int
from plotwright.session import materialize

FREE_MARKET, DWELLING = "wolnyRynek", "mieszkalna"
#: Share of the larger plot by which two plots of one house may differ.
PLOT_SHARE = 0.1


def clean_deeds(raw: DataFrame, kind: str) -> DataFrame:
    """Register features (texts) as typed deeds: dated, priced, free-market; flats must be dwellings and have an area."""
    flat = kind == "flat"
    p = "lok" if flat else "bud"
    number = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0))
    blank_or = lambda c, v: F.coalesce(F.col(c), F.lit("")).isin("", v)
    out = raw.filter(blank_or("tran_rodzaj_trans", FREE_MARKET)).select(
        F.lit(kind).alias("kind"), F.left(F.col("dok_data"), F.lit(10)).try_cast("date").alias("d"),
        half_even(F.coalesce(number(f"{p}_cena_brutto"), number("tran_cena_brutto"))).cast("bigint").alias("c"), F.col(f"{p}_pow_uzyt").try_cast("double").alias("a"),
        (truncated_int(F.col("lok_liczba_izb")) if flat else F.lit(None).cast("int")).alias("izb"), (truncated_int(F.col("lok_nr_kond")) if flat else F.lit(None).cast("int")).alias("kond"),
        (F.lit(None).cast("double") if flat else F.col("nier_pow_gruntu").try_cast("double")).alias("grunt"), F.nullif(F.left(F.col("tran_rodzaj_rynku"), F.lit(1)), F.lit("")).alias("rynek"),
        *[register_field(F.col(f"{p}_adres"), k).alias(n) for k, n in (("MSC", "msc"), ("UL", "ul"), ("NR_PORZ", "nr"))],
        parcel_of_unit(F.col("lok_id_lokalu" if flat else "bud_id_budynku")).alias("dz"), *([F.col("lok_funkcja").alias("__use")] if flat else []),
    )
    out = out.filter(F.col("d").isNotNull() & F.col("c").isNotNull())
    if flat:
        out = out.filter(F.coalesce("a", F.lit(0.0)) != 0).filter(blank_or("__use", DWELLING)).drop("__use")
    return out.dropDuplicates()


def band_candidates(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: tuple[str, str], tolerance: float) -> DataFrame:
    """Pairs equal in ``keys`` whose values are at most ``tolerance`` apart.

    The band becomes an equi-join: the left side is sent to its bin and both neighbours, so a key with a
    third of all rows is spread over its bins instead of meeting in one task.
    """
    lv, rv = value
    bin_of = lambda c: F.floor(F.col(c) / F.lit(float(tolerance)))
    probe = left.withColumn("__bin", F.explode(F.array(*[bin_of(lv) + d for d in (-1, 0, 1)])))
    held = right.withColumn("__rbin", bin_of(rv))
    on = (F.col("__bin") == F.col("__rbin")) & (F.abs(F.col(lv) - F.col(rv)) <= F.lit(float(tolerance)))
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    return probe.join(held, on).drop("__bin", "__rbin")


def town_of_record(records: DataFrame, deeds: DataFrame, by_kind: bool = False) -> DataFrame:
    """``records`` with ``town``: the folded locality if deeds (``by_kind``: of the record's kind) know it as a town, else the district if they know that."""
    kind = ["kind"] if by_kind else []
    known = deeds.select(plain(F.col("msc")).alias("t"), *kind).filter("t != ''").distinct()
    a, b = (known.select(F.col("t").alias(f"t{x}"), *[F.col(k).alias(f"k{x}") for k in kind]) for x in "ab")
    r = records.withColumns({"__l": plain(F.col("locality")), "__d": plain(F.col("district"))})
    same = lambda x: F.col("type") == F.col(f"k{x}") if by_kind else F.lit(True)
    met = r.join(a, (F.col("__l") == F.col("ta")) & same("a"), "left").join(b, (F.col("__d") == F.col("tb")) & same("b"), "left")
    return met.withColumn("town", F.coalesce("ta", "tb")).drop("__l", "__d", "ta", "tb", "ka", "kb")


def within(d: Column, low: Column, high: Column) -> Column:
    """Inclusive range with open ends where a bound is null."""
    return (low.isNull() | (d >= low)) & (high.isNull() | (d <= high))


def sale_windows(d: Column, first_seen: Column, delisted: Column, before: int = LIMITS.sold_before_days, after: int = LIMITS.sold_after_days) -> Column:
    """The windows a deed falls into: ``past`` before the first sighting, ``sold`` around the delisting."""
    past = within(d, F.lit(None).cast("date"), F.date_sub(first_seen, 1))
    sold = delisted.isNotNull() & within(d, F.date_sub(delisted, before), F.date_add(delisted, after))
    return F.array_compact(F.array(F.when(past, "past"), F.when(sold, "sold")))


def deed_score(unique: Column) -> Column:
    """2 certain, 1 likely, 0 rejected, for a candidate with the property's and the deed's columns side by side.

    Same parcel or same street and number decide; else rooms and storey of flats, or the plots of houses, must speak
    for the pair, or it must be the only candidate for a finely measured area.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    parcels, streets, numbers = known("dzialka_id") & known("dz"), known("street") & known("ul"), known("nr") & known("deed_nr")
    same_parcel, same_street = plain(F.col("dzialka_id")) == plain(F.col("dz")), streets_agree(F.col("street"), F.col("ul"))
    rooms_known, floor_known = known("rooms") & known("izb"), known("floor_no") & known("kond")
    rooms_ok, floor_ok = F.col("rooms") == F.col("izb"), (F.col("kond") == F.col("floor_no")) | (F.col("kond") == F.col("floor_no") + 1)
    hits = F.when(rooms_known & rooms_ok, 1).otherwise(0) + F.when(floor_known & floor_ok, 1).otherwise(0)
    alone = unique & has_decimals(F.col("area"))
    plot, deed_plot = F.coalesce("plot_area", F.lit(0.0)), F.coalesce("grunt", F.lit(0.0))
    plots = (plot != 0) & (deed_plot != 0)
    flat = F.when((rooms_known & ~rooms_ok) | (floor_known & ~floor_ok), 0).when((hits == 2) | alone, 1).otherwise(0)
    house = F.when(plots & (F.abs(plot - deed_plot) <= PLOT_SHARE * F.greatest(plot, deed_plot)), 1).when(~plots & alone, 1).otherwise(0)
    return (
        F.when(parcels & same_parcel, 2)
        .when(streets & same_street & numbers, F.when(plain(F.col("nr")) == plain(F.col("deed_nr")), 2).otherwise(0))
        .when(streets & same_street, F.when(F.col("a").isNull(), 0).otherwise(2))
        .when(streets | parcels | F.col("a").isNull(), 0)
        .when(F.col("type") == "flat", flat)
        .otherwise(house)
    )


#: What a match rests on: by score.
CONFIDENCE = {2: "high", 1: "medium"}
# Market codes of the register.
MARKETS = {"p": "primary", "w": "secondary"}


def _matchable(records: DataFrame) -> DataFrame:
    """Records that deeds can be attributed to: no developments, whose pictures do not show one dwelling."""
    out = records.filter(F.col("type").isin("flat", "house"))
    return out.filter(~F.coalesce("development", F.lit(False))) if "development" in records.columns else out


def deed_candidates(records: DataFrame, deeds: DataFrame, tolerance: float = LIMITS.area_tolerance) -> DataFrame:
    """Records side by side with the deeds of their kind and town within the area tolerance.

    A record whose house number or parcel is known also meets the deeds without area that name a street: those are
    judged by street and number alone.
    """
    left = town_of_record(records, deeds, by_kind=True).filter("town is not null and area is not null")
    right = deeds.withColumn("deed_town", plain(F.col("msc"))).withColumnsRenamed({"kind": "deed_kind", "nr": "deed_nr"})
    keys = [("town", "deed_town"), ("type", "deed_kind")]
    met = band_candidates(left, right, keys, ("area", "a"), tolerance)
    pinned = left.filter((F.coalesce("nr", F.lit("")) != "") | (F.coalesce("dzialka_id", F.lit("")) != ""))
    on = (F.col("town") == F.col("deed_town")) & (F.col("type") == F.col("deed_kind"))
    return met.unionByName(pinned.join(right.filter("a is null and coalesce(ul, '') != ''"), on))


def _known(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _bins(value: Column, reach: float) -> Column:
    """Bins of width ``2 * reach`` that values at most ``reach`` away can be in: two at most, or three at an edge."""
    return F.sequence(F.floor((value - F.lit(reach + 1e-6)) / F.lit(2.0 * reach)), F.floor((value + F.lit(reach + 1e-6)) / F.lit(2.0 * reach)))


def _bin(value: Column, reach: float) -> Column:
    return F.floor(value / F.lit(2.0 * reach))


def _told(left: DataFrame) -> Row:
    """How many of the records tell a ``parcel``, a house ``number``, rooms and ``storey`` of a flat, the ``plot`` of a house."""
    flat, house = "type = 'flat' and rooms is not null and floor_no is not null", "type != 'flat' and plot > 0"
    return left.agg(F.count("r_dz").alias("parcel"), F.count("r_nr").alias("number"), F.count_if(F.expr(flat)).alias("storey"), F.count_if(F.expr(house)).alias("plot")).first()


def _sides(records: DataFrame, deeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a town and an area, and deeds, with what :func:`deed_score` compares read once; equal deeds are one row with their number ``n``.

    Null where a detail is not told; numbers and parcels of deeds are also null if no record tells one to compare them with.
    """

    def read(df: DataFrame, side: str, street: str, number: str | None, parcel: str | None) -> DataFrame:
        words, told = F.when(_known(street), street_words(F.col(street))), lambda c: F.when(_known(c), plain(F.col(c))) if c else F.lit(None).cast("string")
        out = df.withColumns({f"{side}_words": words, f"{side}_nr": told(number), f"{side}_dz": told(parcel)})
        # Last words that agree are equal or begin with the same four letters.
        return out.withColumn(f"{side}_begin", F.left(F.try_element_at(f"{side}_words", F.lit(-1)), F.lit(4)))

    # Written, or the towns would be folded for each deed, not for each spelling.
    spelled = materialize(deeds.select("msc", "kind").distinct(), "towns")
    left = town_of_record(records, spelled, by_kind=True).filter("town is not null and area is not null")
    left = left.select("record_id", "type", "town", "area", "street", "nr", "dzialka_id", "rooms", "floor_no", F.coalesce("plot_area", F.lit(0.0)).alias("plot"), "first_seen", "delisted")
    left = materialize(read(left, "r", "street", "nr", "dzialka_id").drop("street", "nr", "dzialka_id"), "records")
    told = _told(left)
    # Deeds without a town stay: a filter would fold every town once more, and no record meets them.
    right = deeds.select(plain(F.col("msc")).alias("town"), F.col("kind").alias("type"), "d", "c", "a", "izb", "kond", F.coalesce("grunt", F.lit(0.0)).alias("grunt"), "rynek", "ul", F.col("nr").alias("deed_nr"), "dz")
    right = right.groupBy(*right.columns).agg(F.count(F.lit(1)).alias("n"))
    return left, materialize(read(right, "d", "ul", "deed_nr" if told["number"] else None, "dz" if told["parcel"] else None), "deeds")


_PINNED, _UNMEASURED = "r_nr is not null or r_dz is not null", "a is null and coalesce(ul, '') != ''"


def _candidate_counts(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """``record_id, several, sole``: records with candidates, whether there are several, and the area of the only one (null where it has none).

    No candidate is listed: of the deeds of one bin of areas only the two smallest and two largest areas are asked. A bin is
    half a tolerance wide, so either all of it is within a record's band or one of its ends tells none, one or several.
    """
    key, bin_of = ["town", "type"], lambda c: F.floor(F.col(c) / F.lit(tolerance / 2))
    areas = right.filter("a is not null").select(*key, "a", "n", bin_of("a").alias("bin")).repartition(*key, "bin").groupBy(*key, "bin", "a").agg(F.sum("n").alias("n"))
    within_bin = Window.partitionBy(*key, "bin")
    ends = areas.withColumns({"k": F.row_number().over(within_bin.orderBy("a")), "last": F.count(F.lit(1)).over(within_bin)}).filter("k <= 2 or k >= last - 1").drop("k", "last")
    asked = left.select(*key, "area").distinct().withColumn("bin", F.explode(F.sequence(bin_of("area") - 3, bin_of("area") + 3)))
    near = asked.join(ends, [*key, "bin"]).filter(F.abs(F.col("area") - F.col("a")) <= F.lit(float(tolerance)))
    near = near.groupBy(*key, "area").agg(F.sum("n").alias("n"), F.min("a").alias("sole"))
    unmeasured = right.filter(_UNMEASURED).groupBy(*key).agg(F.sum("n").alias("m"))
    met = left.select("record_id", *key, "area", F.expr(_PINNED).alias("pinned")).join(near, [*key, "area"], "left").join(unmeasured, key, "left")
    met = met.withColumn("n", F.coalesce("n", F.lit(0)) + F.when(F.col("pinned"), F.coalesce("m", F.lit(0))).otherwise(0)).filter("n > 0")
    return met.groupBy("record_id").agg((F.sum("n") > 1).alias("several"), F.min("sole").alias("sole")).filter("record_id is not null")


def _scored(left: DataFrame, right: DataFrame, counts: DataFrame, tolerance: float) -> DataFrame:
    """The candidates that :func:`deed_score` does not reject, each once, with their score: every rule of it is a join on what that rule wants equal or near.

    A rule that no record tells enough for is left out, so the deeds are not shuffled for it.
    """
    told = _told(left)
    key, band = ["town", "type"], F.abs(F.col("area") - F.col("a")) <= F.lit(float(tolerance))
    probe = left.withColumn("bin", F.explode(_bins(F.col("area"), tolerance)))
    measured, unmeasured = right.filter("a is not null").withColumn("bin", _bin(F.col("a"), tolerance)), right.filter(_UNMEASURED)
    meet = lambda r, d, what, *also: r.withColumn("x", F.col(f"r_{what}")).join(d.withColumn("x", F.col(f"d_{what}")), [*key, *also, "x"])
    or_unknown = lambda c: F.coalesce(c, F.lit(True))
    same_parcel = F.coalesce(F.col("r_dz") == F.col("d_dz"), F.lit(False)) if told["parcel"] else F.lit(False)
    same_street = ~same_parcel & word_lists_agree(F.col("r_words"), F.col("d_words"))
    # Neither streets nor parcels can be compared.
    silent = (F.col("r_words").isNull() | F.col("d_words").isNull()) & (F.col("r_dz").isNull() | F.col("d_dz").isNull())
    # Numbers agree or one is unknown: each such pair has one key in common.
    numbered = lambda df, side, known, unknown: df.withColumn("number", F.explode(F.when(F.col(f"{side}_nr").isNotNull(), F.array(F.concat(F.lit("="), f"{side}_nr"), F.lit(known))).otherwise(unknown)))
    asked, listed, number = probe, measured, []
    if told["number"]:
        asked, listed, number = numbered(probe, "r", "none", F.array(F.lit("any"))), numbered(measured, "d", "any", F.array(F.lit("none"), F.lit("any"))), ["number"]
    floors = probe.filter("type = 'flat'").withColumn("kond", F.explode(F.array(F.col("floor_no"), F.col("floor_no") + 1)))
    apart = -math.log(1 - PLOT_SHARE)
    plots = probe.filter("type != 'flat' and plot > 0").withColumn("plot_bin", F.explode(_bins(F.log("plot"), apart)))
    alike = F.abs(F.col("plot") - F.col("grunt")) <= PLOT_SHARE * F.greatest("plot", "grunt")
    # Few records have one candidate only: written, so that they and not the deeds are sent.
    sole = left.filter(has_decimals(F.col("area"))).join(counts.filter("not several and sole is not null").select("record_id", F.col("sole").alias("a")), "record_id")
    sole = materialize(sole.drop("r_nr", "r_begin"), "sole")
    both = F.col("rooms").isNotNull() & F.col("izb").isNotNull() & F.col("floor_no").isNotNull() & F.col("kond").isNotNull()
    not_against = or_unknown(F.col("rooms") == F.col("izb")) & or_unknown((F.col("kond") == F.col("floor_no")) | (F.col("kond") == F.col("floor_no") + 1))
    met = [
        (2, told["parcel"], lambda: meet(left, right, "dz").filter(band | F.expr(_UNMEASURED))),
        (2, True, lambda: meet(asked, listed, "begin", "bin", *number).filter(band & same_street)),
        (2, told["number"], lambda: meet(left, unmeasured, "nr").filter((F.col("r_begin") == F.col("d_begin")) & same_street)),
        (1, told["storey"], lambda: floors.join(measured.withColumn("rooms", F.col("izb")), [*key, "bin", "rooms", "kond"]).filter(band & silent)),
        (1, told["plot"], lambda: plots.join(measured.filter("grunt > 0").withColumn("plot_bin", _bin(F.log("grunt"), apart)), [*key, "bin", "plot_bin"]).filter(band & silent & alike)),
        (1, True, lambda: sole.join(right, [*key, "a"]).filter(band & silent & F.when(F.col("type") == "flat", not_against & ~both).otherwise(F.expr("plot = 0 or grunt = 0")))),
    ]
    return reduce(DataFrame.unionByName, [m.select("record_id", "d", "c", "a", F.lit(score).alias("score"), "rynek", "ul", "deed_nr", "dz", "n", "first_seen", "delisted") for score, ever, m in ((s, e, f()) for s, e, f in met if e)])


def match_deeds(records: DataFrame, deeds: DataFrame, tolerance: float = LIMITS.area_tolerance) -> DataFrame:
    """``record_id, kind, d, price, price_m2, score, confidence, market, addr, dz``: the deeds attached to records.

    A sale needs exactly one best deed in its window; earlier sales at most three; a deed in both windows counts as
    earlier. Developments have none. The candidates are those of :func:`deed_candidates`, but only what scores is joined
    and the others are counted; counts and best scores are aggregates joined back, so no record's candidates are
    gathered in a task; only the deeds kept, four at most, are ranked.
    """
    left, right = _sides(_matchable(records), deeds)
    return _attached(left, right, _candidate_counts(left, right, tolerance), tolerance)


def _attached(left: DataFrame, right: DataFrame, counts: DataFrame, tolerance: float) -> DataFrame:
    scored = _scored(left, right, counts, tolerance)
    sale = materialize(scored.withColumn("sale", F.explode(sale_windows(F.col("d"), F.col("first_seen"), F.col("delisted")))).drop("first_seen", "delisted"), "sales")
    best = sale.groupBy("record_id", "sale").agg(F.max("score").alias("top"), F.sum(F.when(F.col("score") == 2, F.col("n")).otherwise(0)).alias("sure"), F.sum("n").alias("all"))
    n = F.when(F.col("top") == 2, F.col("sure")).otherwise(F.col("all"))
    clear = best.filter(((F.col("sale") == "sold") & (n == 1)) | ((F.col("sale") == "past") & (n <= 3))).select("record_id", "sale", F.col("top").alias("score"))
    kept = sale.join(clear, ["record_id", "sale", "score"])
    one = Window.partitionBy("record_id", "d", "c").orderBy("sale", "dz", "ul", "deed_nr", "a", "rynek")
    label = lambda known, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c)
    return kept.withColumn("k", F.row_number().over(one)).filter("k = 1").select(
        "record_id", F.col("sale").alias("kind"), "d", F.col("c").alias("price"), price_per_m2(F.col("c"), F.col("a")).alias("price_m2"), "score",
        label(CONFIDENCE, F.col("score")).alias("confidence"), label(MARKETS, F.col("rynek")).alias("market"), F.nullif(F.concat_ws(" ", F.nullif("ul", F.lit("")), F.nullif("deed_nr", F.lit(""))), F.lit("")).alias("addr"), "dz",
    )


def match_funnel(records: DataFrame, deeds: DataFrame, tolerance: float = LIMITS.area_tolerance) -> DataFrame:
    """``stage, n``: how far each record came: no_location (neither locality nor district), no_candidates, rejected or matched; the stages exclude each other."""
    records = _matchable(records)
    left, right = _sides(records, deeds)
    counts = materialize(_candidate_counts(left, right, tolerance), "counts")
    met = counts.select("record_id", F.lit(True).alias("met"))
    done = _attached(left, right, counts, tolerance).select("record_id").distinct().withColumn("done", F.lit(True))
    blank = (F.coalesce(plain(F.col("locality")), F.lit("")) == "") & (F.coalesce(plain(F.col("district")), F.lit("")) == "")
    stage = F.when(F.col("met").isNull() & blank, "no_location").when(F.col("met").isNull(), "no_candidates").when(F.col("done").isNull(), "rejected").otherwise("matched")
    return records.join(met, "record_id", "left").join(done, "record_id", "left").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def report(deeds: DataFrame, town: str, kind: str, area: float | None = None, street: str | None = None, number: str | None = None, rooms: int | None = None, floor: int | None = None, plot_area: float | None = None, dzialka_id: str | None = None, tolerance: float = LIMITS.area_tolerance) -> DataFrame:
    """The deeds :func:`search_deeds` finds for a property, each with ``score`` and a ``line`` that says what was sold and how sure it is."""
    found = search_deeds(deeds, town, area, tolerance, street, number, kind).withColumnRenamed("nr", "deed_nr")
    alone = found.limit(2).count() == 1
    given = {"type": (kind, "string"), "area": (area, "double"), "street": (street, "string"), "nr": (number, "string"), "rooms": (rooms, "int"), "floor_no": (floor, "int"), "plot_area": (plot_area, "double"), "dzialka_id": (dzialka_id, "string")}
    asked = found.withColumns({k: F.lit(v).cast(t) for k, (v, t) in given.items()}).withColumn("score", deed_score(F.lit(alone)))
    text = lambda c, unit="": F.when(F.col(c).isNotNull(), F.concat(F.col(c).cast("string"), F.lit(unit)))
    mark = F.when(F.col("score") == 2, "high").when(F.col("score") == 1, "medium").otherwise("-")
    line = F.concat_ws("  ", mark, F.col("d").cast("string"), text("c", " zł"), text("a", " m2"), text("izb", " rooms"), text("kond", " storey"), text("grunt", " m2 plot"), F.nullif(F.concat_ws(" ", "ul", "deed_nr"), F.lit("")), F.col("dz"))
    return asked.select("d", "c", "a", "ul", F.col("deed_nr").alias("nr"), "dz", "score", line.alias("line")).orderBy("d", "c", "ul", "nr")


def search_deeds(deeds: DataFrame, town: str, area: float | None = None, tolerance: float = LIMITS.area_tolerance, street: str | None = None, number: str | None = None, kind: str | None = None) -> DataFrame:
    """Deeds of a town, near an area, on a street, at a number, by date."""
    out = deeds.filter(plain(F.col("msc")) == plain(F.lit(town)))
    if kind:
        out = out.filter(F.col("kind") == kind)
    if area is not None:
        out = out.filter(F.abs(F.col("a") - F.lit(float(area))) <= F.lit(float(tolerance)))
    if street:
        out = out.filter(streets_agree(F.col("ul"), F.lit(street)))
    if number:
        out = out.filter(plain(F.col("nr")) == plain(F.lit(number)))
    return out.orderBy("d", "c")
