"""Sessions and the shared work folder.

Lineage is cut with written tables, never with ``localCheckpoint``: the files
live in the folder named by ``spark.checkpoint.dir`` (shared by all executors),
so a lost executor costs a re-read, not the job.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{n}]").appName("plotwright").config(map={**base, **conf}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, below ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a folder of our own is made.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _OWN.get(app)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = _OWN[app] = "file://" + tempfile.mkdtemp(prefix="plotwright-")
    return f"{base.rstrip('/')}/plotwright-{app}"


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, whatever their working folder is.

    Once per application the package is zipped into the shared work folder and handed to Spark.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, str(Path(here.name) / f.relative_to(here)))
    path = f"{work_dir(spark)}/{here.name}.zip"
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p.getParent())
    out = fs.create(p, True)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder that is not used yet; removed when the session ends."""
    ship_code(spark)
    root = work_dir(spark)
    fs, p = _fs_path(spark, root)
    fs.deleteOnExit(p)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of lineage that survives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._plotwright_path = path
    return back


def materialize_with(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and aggregates of the rows taken while they are written, without another pass."""
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return table, seen.get


def spread(df: DataFrame) -> DataFrame:
    """A plain scan with at least one partition per core: small files would else keep an expensive map on one."""
    ship_code(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(df: DataFrame | None) -> None:
    """Remove a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_plotwright_path", None)
    if path:
        fs, p = _fs_path(df.sparkSession, path)
        fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
