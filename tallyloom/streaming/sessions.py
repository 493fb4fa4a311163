"""Ledger reports over a stream of calls: sessions by key and days, with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ledger import saved_bytes
from tallyloom.sources.schema import CALLS
from tallyloom.sources.sinks import append_calls


def read_calls(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Calls as they are appended below a folder."""
    return spark.readStream.schema(CALLS).options(**options).parquet(path)


def session_stream(calls: DataFrame, key: Column, gap: str = "1800 seconds", late: str = "1 hour") -> DataFrame:
    """Closed sessions of each key; calls later than the watermark allows are dropped. Spark streams sessions by key only."""
    at = calls.withColumn("at", F.timestamp_seconds("timestamp")).withColumn("key", key).withWatermark("at", late)
    windows = at.groupBy("key", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.avg((F.col("passthrough") == 0).cast("double")).alias("share"))
    return windows.select("key", F.col("w.start").alias("start"), "calls", F.round(F.col("share") * 100, 1).alias("adoption"))


def daily_stream(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Saved bytes by day."""
    at = calls.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    days = at.groupBy(F.window("at", "1 day").alias("w")).agg(F.coalesce(F.sum(saved_bytes()), F.lit(0)).alias("saved"), F.count(F.lit(1)).alias("calls"))
    return days.select(F.to_date("w.start").alias("day"), "saved", "calls")


def write(stream: DataFrame, path: str, checkpoint: str, **options):
    """Appends closed windows to Parquet; starts and returns the query."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def append_stream(calls: DataFrame, path: str, checkpoint: str, name: str = "stream", settings: dict | None = None, **options):
    """Appends a stream to a ledger, each micro-batch under the stream's name and the batch's number; a batch that is delivered again replaces itself. Starts and returns the query."""
    sink = lambda rows, number: append_calls(rows, path, f"{name}-{number}", settings)
    return calls.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
