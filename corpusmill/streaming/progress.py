"""Progress logs: step timings, resuming, and the same hourly rollup for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def step_timings(log: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Adds ``step_s`` since the entry before (null for the first) and ``elapsed_s`` since the first."""
    w = Window.partitionBy(key).orderBy(ts, order)
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    return log.withColumn("step_s", (now - F.lag(now).over(w)) / 1_000_000).withColumn("elapsed_s", (now - F.first(now).over(w)) / 1_000_000)


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def unexpected(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a log claims that was never asked; a resumed run should refuse to go on."""
    return done.join(wanted.select(*keys).distinct(), keys, "left_anti")


def hourly(events: DataFrame) -> DataFrame:
    """``event_type, start, n, total`` of rows ``ts, event_type, value``; a stream needs a watermark on ``ts``."""
    found = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("event_type", F.col("w.start").alias("start"), "n", "total")


def follow(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, target: str, delay: str = "10 minutes"):
    """Streams Parquet files of events into hourly rollups under ``target``: exactly once, late rows up to ``delay``; returns the query."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", delay)
    return hourly(events).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
