"""Sessions: calls with at most a given gap between neighbours, over all calls in order of time.

The ledger's sessions have no key, so a plain window would sort all calls in one task. Here each day is sessionized by itself and only the days' outer sessions, two rows a day at most, meet in one task to be stitched. A gap of exactly the limit does not part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 1800


def _islands(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Numbers runs of (first, last) rows whose distance is at most gap, within `by`."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("breaks", F.coalesce((F.col("first") - reach > gap).cast("int"), F.lit(1))).withColumn("island", F.sum("breaks").over(order))


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("calls").alias("calls"), F.sum("adopted").alias("adopted")).drop("island")


def spans(calls: DataFrame, gap: int = GAP, keys: list[str] | None = None) -> DataFrame:
    """first, last, calls and adopted (those that weren't passed through) of each session."""
    keys = keys or []
    width = max(86400, gap)
    # one row a second before anything is sorted
    seconds = calls.groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("passthrough") == 0).cast("bigint")).alias("adopted"))
    seconds = seconds.select(*keys, F.floor(F.col("timestamp") / width).alias("slice"), F.col("timestamp").alias("first"), F.col("timestamp").alias("last"), "calls", "adopted")
    by_slice = _merged(_islands(seconds, [*keys, "slice"], gap), [*keys, "slice"])
    # only a session near its slice's edge can meet another one
    low, high = F.col("slice") * width, (F.col("slice") + 1) * width
    inner = (F.col("first") - low > gap) & (high - 1 - F.col("last") > gap)
    sessions = by_slice.withColumn("inner", inner)
    outer = _merged(_islands(sessions.where(~F.col("inner")), keys, gap), keys)
    return sessions.where("inner").select(*keys, "first", "last", "calls", "adopted").unionByName(outer.select(*keys, "first", "last", "calls", "adopted"))


def sessions(calls: DataFrame, gap: int = GAP) -> DataFrame:
    """Start and percent of adopted calls of each session, in order of time."""
    return spans(calls, gap).select(F.date_format(F.timestamp_seconds("first"), "yyyy-MM-dd HH:mm:ss").alias("start"), "calls", F.round(F.col("adopted") / F.col("calls") * 100, 1).alias("adoption")).orderBy("start")
