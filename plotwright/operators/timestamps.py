"""Mixed timestamp notations normalised to one exact instant.

Raw strings are deduplicated with their source and zone into a dictionary of distinct
values, each value is parsed once with JVM expressions, the dictionary is a written table
that later runs extend, and the instants are joined back to the rows.

Defined results
---------------
* null, empty, blank or unreadable text, impossible dates (30 February) and times
  (27:15): no instant (``created_ms`` null in the dictionary, row absent from
  :func:`normalize_instants`).
* text of any length is matched as a whole; a value that continues after the notation is unreadable.
* repeated rows each keep their row; an empty table gives an empty table.
* columns beyond those named are carried along untouched; helper columns start with ``__ts_``.
* without zone: wall time of the source's zone (``zones``), else ``default_zone``. A wall time
  that occurs twice is the first one; a skipped one takes the offset before the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.functions.text import squeeze
from plotwright.operators.skew import lookup_join
from plotwright.session import materialize, path_exists

DEFAULT_ZONE = "Europe/Warsaw"

# Month names by their first letters (Polish, English), in calendar order.
MONTHS = [
    ("sty", "jan"), ("lut", "feb"), ("mar",), ("kwi", "apr"), ("maj", "may"), ("cze", "jun"),
    ("lip", "jul"), ("sie", "aug"), ("wrz", "sep"), ("paź", "paz", "oct"), ("lis", "nov"), ("gru", "dec"),
]
# Minutes east of UTC for zone abbreviations.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120,
    "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_ZONE = r"(?:(z|[a-z]{2,4})?(?:([+-])(\d{2}):?(\d{2})?)?(?:\[[a-z]+(?:/[a-z_]+)+\])?)"
_CLOCK = r"(?:(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?)?)"
_TAIL = rf"(?:[t ]?{_CLOCK} ?{_ZONE})?$"

#: (pattern over the tidied text, replacement): year|month|day|hour|minute|second|fraction|half|zone|sign|zh|zm
_NOTATIONS = [
    (rf"^(\d{{4}})([-./])(\d{{1,2}})\2(\d{{1,2}}){_TAIL}", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|$12|$13"),
    (rf"^(\d{{1,2}})([-./])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TAIL}", "$4|$3|$1|$5|$6|$7|$8|$9|$10|$11|$12|$13"),
    (rf"^(\d{{1,2}})[ .-]?(\p{{L}}{{3,12}})\.?[ .-]?(\d{{4}}|\d{{2}}){_TAIL}", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    (rf"^(\p{{L}}{{3,12}})\.? (\d{{1,2}}) (\d{{4}}){_TAIL}", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)? ?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|$10|$11"),
    (rf"^(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))? (\d{{1,2}})([-./])(\d{{1,2}})\5(\d{{4}}|\d{{2}})(?: {_ZONE})?$", "$7|$6|$4|$1|$2|$3|||$8|$9|$10|$11"),
]


def _tidy(raw: Column) -> Column:
    """Lower case, single spaces, without labels, weekday, year suffix and hour words."""
    t = squeeze(raw)
    t = F.lower(t)
    t = F.regexp_replace(t, r"^\p{L}[\p{L} ]*: ?", "")
    t = F.regexp_replace(t, r"^\p{L}{2,12}\.?, ", "")
    t = F.regexp_replace(t, r" ?,? (?:godz\.?|g\.|o|at)(?= \d)", "")
    t = F.regexp_replace(t, r" (?:r\.|r|roku|rok)(?=$|[ ,])", "")
    return F.regexp_replace(t, r"(?<=[\p{L}\d]),(?= )", "")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; plain columns would be inlined at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_instant_ms(raw: Column, zone: Column) -> Column:
    """Milliseconds since the epoch of a timestamp text, null when it names no real instant."""

    def notation(t: Column) -> Column:
        shaped = t
        for pattern, out in _NOTATIONS:
            shaped = F.regexp_replace(shaped, pattern, out)
        written = _bind(F.split(shaped, r"\|", -1), lambda p: F.when(F.size(p) == 12, _instant(p, zone)))
        count = t.try_cast("bigint")
        return (
            F.when(t.rlike(r"^\d{10}$"), count * 1000)
            .when(t.rlike(r"^\d{13}$"), count)
            .when(t.rlike(r"^\d{16}$"), F.floor(count / 1000))
            .otherwise(written)
        )

    return _bind(_tidy(raw), notation)


def _instant(p: Column, zone: Column) -> Column:
    part = lambda i: F.get(p, F.lit(i))
    num = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    months = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS) for name in names for x in (name, i + 1)])
    month = F.coalesce(part(1).try_cast("int"), F.try_element_at(months, F.substring(part(1), 1, 3)))
    year = part(0).try_cast("int") + F.when(F.length(part(0)) == 2, 2000).otherwise(0)
    day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")).try_cast("date")
    half = part(7)
    hour = F.when(half == "p", num(3) % 12 + 12).when(half == "a", num(3) % 12).otherwise(num(3))
    hour_ok = F.when(half != "", (num(3) >= 1) & (num(3) <= 12)).otherwise(num(3) <= 23)
    clock_ok = hour_ok & (num(4) <= 59) & (num(5) <= 59) & (num(10) <= 14) & (num(11) <= 59)
    ms = (hour * 3600 + num(4) * 60 + num(5)).cast("bigint") * 1000 + F.rpad(F.substring(part(6), 1, 3), 3, "0").try_cast("int")
    local = F.unix_date(day).cast("bigint") * 86_400_000 + ms
    abbr = F.create_map(*[F.lit(x) for k, v in ZONE_MINUTES.items() for x in (k, v)])
    named = F.try_element_at(abbr, part(8))
    offset = F.coalesce(named, F.lit(0)) + F.when(part(9) == "-", -1).otherwise(1) * (num(10) * 60 + num(11))
    zoned = local - offset.cast("bigint") * 60_000
    wall = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local), zone))
    return F.when(clock_ok & month.isNotNull() & day.isNotNull(), F.when((part(8) == "") & (part(9) == ""), wall).when((part(8) == "") | named.isNotNull(), zoned))


def _zone_of(source: Column | None, zones: dict[str, str], default_zone: str) -> Column:
    if source is None or not zones:
        return F.lit(default_zone)
    known = F.create_map(*[F.lit(x) for k, v in zones.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, source), F.lit(default_zone))


def build_dictionary(rows: DataFrame, column: str = "created", source: str | None = "source", zones: dict[str, str] | None = None, default_zone: str = DEFAULT_ZONE, path: str | None = None) -> DataFrame:
    """The dictionary of distinct (source, zone, raw) values of ``rows`` with their instants.

    With ``path`` the table there is read first and only values it lacks are parsed and
    appended; without, a fresh table is written to the session's shared folder. The result
    has ``__ts_source, __ts_zone, __ts_raw, created_ms, __ts_n`` (rows in ``rows``).
    """
    spark: SparkSession = rows.sparkSession
    src = F.col(source) if source else None
    keys = ["__ts_source", "__ts_zone", "__ts_raw"]
    seen = (
        rows.filter(F.col(column).isNotNull())
        .select(F.coalesce(src, F.lit("")).alias("__ts_source") if source else F.lit("").alias("__ts_source"), _zone_of(src, zones or {}, default_zone).alias("__ts_zone"), F.col(column).alias("__ts_raw"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__ts_n"))
    )
    parsed = lambda d: d.withColumn("created_ms", parse_instant_ms(F.col("__ts_raw"), F.col("__ts_zone")))
    if path is None:
        return materialize(parsed(seen), "instants")
    if path_exists(spark, path):
        known = spark.read.parquet(path)
        parsed(seen.select(*keys).join(known.select(*keys), keys, "left_anti")).write.mode("append").parquet(path)
    else:
        parsed(seen.select(*keys)).write.parquet(path)
    return spark.read.parquet(path).dropDuplicates(keys).join(seen, keys)


def normalize_instants(rows: DataFrame, column: str = "created", source: str | None = "source", zones: dict[str, str] | None = None, default_zone: str = DEFAULT_ZONE, path: str | None = None, out: str = "created_ms") -> DataFrame:
    """``rows`` whose ``column`` is readable, with the instant in ``out``. See the module text for the cases."""
    keys = ["__ts_source", "__ts_zone", "__ts_raw"]
    d = build_dictionary(rows, column, source, zones, default_zone, path).filter(F.col("created_ms").isNotNull()).withColumnRenamed("created_ms", "__ts_ms")
    src = F.col(source) if source else None
    keyed = rows.filter(F.col(column).isNotNull()).withColumns({
        "__ts_source": F.coalesce(src, F.lit("")) if source else F.lit(""),
        "__ts_zone": _zone_of(src, zones or {}, default_zone),
        "__ts_raw": F.col(column),
    })
    return lookup_join(keyed, d, keys, "__ts_n", ["__ts_ms"]).withColumn(out, F.col("__ts_ms")).drop(*keys, "__ts_ms")
