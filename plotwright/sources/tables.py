"""Register pages, state tables with versions, snapshots with an age, and published outputs."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.functions.numbers import in_box
from plotwright.session import _fs_path, path_exists
from plotwright.sources.schemas import FLAT_DEED, HOUSE_DEED

# Feature names of the register.
FEATURES = {"flat": ("lokale", FLAT_DEED), "house": ("budynki", HOUSE_DEED)}


def register_features(pages: DataFrame, kind: str, tag: str | None = None) -> DataFrame:
    """Features of stored register pages (``xml`` texts) as rows of texts; geometry is never parsed, exception reports hold none."""
    tag, schema = tag or FEATURES[kind][0], FEATURES[kind][1]
    member = F.regexp_extract_all("xml", F.lit(rf"(?s)<ms:{tag}[ >].*?</ms:{tag}>"), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace("m", r"(?s)<ms:(msGeometry|boundedBy)[ >].*?</ms:\1>", ""), r"<(/?)(?:ms|gml):", "<$1")
    bare = F.regexp_replace(bare, r"(<\w+)\s+[^>]*?(/?>)", "$1$2")
    return pages.select(F.explode(member).alias("m")).select(F.from_xml(bare, schema, {"rowTag": tag}).alias("r")).select("r.*")


def register_table(spark: SparkSession, path: str, kind: str | None = None, town: str | None = None, since: dt.date | None = None, areas: tuple[float, float] | None = None, box: tuple[float, float, float] | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """A stored register of deeds, read no further than asked: every condition is a plain comparison that reaches the scan, as do the columns.

    ``town`` as the register writes it; ``box``: x, y and half the width of a square around a point (columns ``x, y``).
    """
    rows = spark.read.parquet(path)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if town is not None:
        rows = rows.filter(F.col("msc") == town)
    if since is not None:
        rows = rows.filter(F.col("d") >= F.lit(since))
    if areas is not None:
        rows = rows.filter((F.col("a") >= float(areas[0])) & (F.col("a") <= float(areas[1])))
    if box is not None:
        rows = rows.filter(in_box(F.col("x"), F.col("y"), *box))
    return rows.select(*columns) if columns else rows


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A table, or an empty one of its schema when it does not exist yet or cannot be read."""
    if path_exists(spark, path):
        found = spark.read.schema(schema).format(form).load(path)
        try:
            found.limit(1).count()
            return found
        except Exception:  # noqa: BLE001 - whatever is wrong with the files, there is no state to go on from
            pass
    return spark.createDataFrame([], schema)


def write_version(df: DataFrame, root: str, form: str = "parquet") -> str:
    """Write a new version of a table beside the old ones, then point to it; readers never see half a table."""
    spark = df.sparkSession
    name = f"v-{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    df.write.format(form).save(f"{root}/{name}")
    fs, pointer = _fs_path(spark, f"{root}/_current.{name}")
    out = fs.create(pointer, True)
    out.writeBytes(name)
    out.close()
    return f"{root}/{name}"


def current_version(spark: SparkSession, root: str) -> str | None:
    """Path of the latest complete version of a table."""
    if not path_exists(spark, root):
        return None
    fs, p = _fs_path(spark, root)
    names = [str(s.getPath().getName()) for s in fs.listStatus(p)]
    marks = sorted(n.removeprefix("_current.") for n in names if n.startswith("_current."))
    return f"{root}/{marks[-1]}" if marks else None


def refresh(spark: SparkSession, root: str, fetch, today: dt.date, days: int = 7) -> DataFrame | None:
    """A snapshot no older than ``days``: reused while young, fetched anew when old, the old one when fetching fails.

    ``fetch()`` gives a DataFrame; the stored table carries the day in ``fetched``.
    """
    path = current_version(spark, root)
    old = spark.read.parquet(path) if path else None
    day = old.agg(F.max("fetched")).first()[0] if old is not None else None
    if day is not None and (today - day).days < days:
        return old
    try:
        return spark.read.parquet(write_version(fetch().withColumn("fetched", F.lit(today)), root))
    except Exception:  # noqa: BLE001 - a failed fetch leaves the snapshot as it is
        return old


def run_summary(cards: DataFrame, archive: DataFrame, raw: DataFrame, funnel: DataFrame | None = None, errors: dict[str, str] | None = None) -> DataFrame:
    """One row that sums up a run: cards, raw rows, both by source and type, relisted, archived, confirmed sales, the match funnel and what failed.

    Rows without source or type count under ``unknown``. Only counts reach the driver, one row per source, type and stage.
    """
    spark = cards.sparkSession
    counts = lambda df, c: {r[0]: r[1] for r in df.groupBy(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("k")).count().collect()}
    by_source, by_type = counts(raw, "source"), counts(cards, "type")
    relisted = cards.agg(F.count_if(F.coalesce("relisted", F.lit(False)))).first()[0] if "relisted" in cards.columns else 0
    gone = archive.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sold").isNotNull()).alias("sold")).first()
    stages = {} if funnel is None else {r["stage"]: r["n"] for r in funnel.collect()}
    row = (sum(by_type.values()), sum(by_source.values()), by_source, by_type, relisted, gone["n"], gone["sold"], stages, dict(errors or {}))
    return spark.createDataFrame([row], "count bigint, raw bigint, by_source map<string,bigint>, by_type map<string,bigint>, relisted bigint, archive bigint, sold_confirmed bigint, funnel map<string,bigint>, errors map<string,string>")


def publish(cards: DataFrame, archive: DataFrame, path: str, raw: DataFrame | None = None, funnel: DataFrame | None = None, errors: dict[str, str] | None = None) -> dict[str, str]:
    """Live cards newest first without hashes, the archive, and the run's summary, each as a new version; the paths written.

    ``raw``: the listing rows of the run, the cards where it is not given.
    """
    live = cards.drop("phashes").orderBy(F.desc_nulls_last("created"), "seq")
    parts = {"listings": live, "archive": archive, "meta": run_summary(cards, archive, cards if raw is None else raw, funnel, errors)}
    return {name: write_version(df, f"{path}/{name}", "json") for name, df in parts.items()}


def pin(overrides: DataFrame, new: DataFrame) -> DataFrame:
    """Overrides by address with the known fields of ``new`` put in place of the old; null fields change nothing.

    Of repeated addresses in ``new`` the last known value of each field counts: by ``pin_seq`` where it has it, else the largest.
    """
    fields = [c for c in overrides.columns if c != "url"]
    order = lambda f: F.col("pin_seq") if "pin_seq" in new.columns else F.col(f)
    n = new.filter("url is not null").groupBy("url").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order(f))).alias(f"n_{f}") for f in fields])
    o = overrides.select("url", *[F.col(f).alias(f"o_{f}") for f in fields])
    return o.join(n, "url", "full").select("url", *[F.coalesce(f"n_{f}", f"o_{f}").alias(f) for f in fields])
