"""Structured Streaming over sightings: one event of a type per user and day, kept up to date.

The aggregation is a minimum, which is merged per micro-batch: state is one number per key and is
dropped when the watermark passes the end of its day, so late rows within the delay still count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.session import _fs_path, fresh_path, path_exists

RESULT = "user_id bigint, day date, event_type string, event_id bigint"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def observe(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Streaming or batch: ``user_id, day, event_type, event_id`` with the smallest event of the day."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("user_id", F.col("w.start").cast("date").alias("day"), "event_type", "event_id")


def distinct_sightings(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Streaming: the first sighting per key within the watermark, without aggregation state that outlives it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def run_available(spark: SparkSession, path: str, delay: str = "7 days") -> DataFrame:
    """Run the job over the files that are there, through a checkpointed stream, and read its result.

    Every micro-batch writes its changed keys under its number, so a batch that runs again after a failure replaces
    itself; the smallest event of a key in any batch is its result. Rows later than ``delay`` after the watermark are
    dropped by the stream; the first run sees all files as one batch, in which none is late.
    """
    fs, p = _fs_path(spark, path)
    folder, file = (path, "*.parquet") if fs.getFileStatus(p).isDirectory() else path.rsplit("/", 1)
    out, state = fresh_path(spark, "observed"), fresh_path(spark, "observed-state")
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", file)
    stream = observe(source.parquet(folder), delay)
    changed = stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    changed.start().awaitTermination()
    if not path_exists(spark, out):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(f"{RESULT}, batch bigint").parquet(out).groupBy("user_id", "day", "event_type").agg(F.min("event_id").alias("event_id"))
