"""Queries that write ledgers and streams made from the events and read them back, and what they give in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import ledger
from tallyloom.sources import derived, sinks
from tallyloom.sources.schema import CALLS
from tallyloom.sources.store import workspace
from tallyloom.streaming import globalsessions
from tallyloom.streaming import sessions as streams

DAY = 86400
#: Files that a replayed stream comes in, and how many of them a call may come late.
PARTS, LATE_PARTS = 2, 1
SAVED = "greatest(0, bytes_before - bytes_after)"


def replay(calls: DataFrame, path: str, each) -> int:
    """Writes calls in parts by time, each call in its own part or the next one, then a heartbeat; runs `each` after every part. Gives the lateness in seconds."""
    spark = calls.sparkSession
    low, high = calls.agg(F.min("timestamp"), F.max("timestamp")).first()
    low, high = low or 0, high or 0
    step = (high - low) // PARTS + 1
    late = LATE_PARTS * step
    own = F.least(F.floor((F.coalesce("timestamp", F.lit(low)) - low) / step) + F.pmod(F.xxhash64("command_text", "timestamp"), F.lit(2)), F.lit(PARTS - 1))
    beat = spark.createDataFrame([(None,) * 6 + (high + late + 30 * DAY, None, None)], CALLS)
    for k in range(PARTS):
        calls.select(*[f.name for f in CALLS]).where(own == k).write.mode("append").parquet(path)
        each(late)
    beat.write.mode("append").parquet(path)
    each(late)
    return late


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions over all calls from a stream that comes in parts, late calls and restarts from the checkpoint included."""
    root = workspace(spark, "stream-sessions")

    def run(late: int) -> None:
        spans = globalsessions.session_spans(streams.read_calls(spark, f"{root}/in"), late=f"{late} seconds", width=DAY)
        streams.write(spans, f"{root}/out", f"{root}/state").awaitTermination()

    replay(derived.calls(spark, sf), f"{root}/in", run)
    out = spark.read.schema("first bigint, last bigint, calls bigint, adopted bigint").parquet(f"{root}/out")
    return out.select(F.date_format(F.timestamp_seconds("first"), "yyyy-MM-dd HH:mm:ss").alias("start"), "calls", F.round(F.col("adopted") / F.col("calls") * 100, 1).alias("adoption"))


def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Savings by category of a ledger that a stream is appended to, with every batch delivered twice."""
    root = workspace(spark, "stream-ledger")

    def twice(rows: DataFrame, number: int) -> None:
        for _ in range(2):
            sinks.append_calls(rows, f"{root}/ledger", f"s-{number}")

    derived.calls(spark, sf).select(*[f.name for f in CALLS]).write.parquet(f"{root}/in")
    streams.read_calls(spark, f"{root}/in").writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = sinks.ledger_batches(spark, f"{root}/ledger")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(ledger.saved_bytes()), F.lit(0)).alias("saved"))


def _kept_ledger(spark: SparkSession, sf: str, label: str) -> str:
    """A ledger of three appends, one of them repeated, less what is over ten and a half days older than the latest call."""
    path, calls = f"{workspace(spark, label)}/ledger", derived.calls(spark, sf)
    for k in (0, 1, 2, 1):
        sinks.append_calls(calls.where(F.col("event_id") % 3 == k).drop("event_id"), path, f"b-{k}")
    now = (calls.agg(F.max("timestamp")).first()[0] or 0) - DAY // 2
    sinks.retain_rows(spark, path, now, 10)
    return path


def retention_exact(spark: SparkSession, sf: str) -> DataFrame:
    """What is left by category and day, read without a filter."""
    rows = sinks.ledger_batches(spark, _kept_ledger(spark, sf, "retention"))
    return rows.groupBy("category", "day").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))


def ledger_rollups(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, raw and saved bytes by day and category from roll-ups alone, after repeated appends and retention."""
    return ledger.rolled_up(sinks.rollups(spark, _kept_ledger(spark, sf, "rollups")), "day", "category")


QUERIES = {"stream_sessions": stream_sessions, "stream_ledger": stream_ledger, "retention_exact": retention_exact, "ledger_rollups": ledger_rollups}

_CALLS = f"with calls as ({derived.CALLS_SQL}), "
_KEPT = f"{_CALLS} kept as (select *, cast(make_timestamp(timestamp * 1000000) as date) as day from calls where timestamp >= (select max(timestamp) from calls) - {DAY // 2} - {10 * DAY})"

ORACLE_SQL = {
    "stream_sessions": f"""{_CALLS} t as (select *, coalesce(timestamp - lag(timestamp) over (order by timestamp) > 1800, true) as starts from calls),
      s as (select *, sum(starts::int) over (order by timestamp rows unbounded preceding) as session from t)
      select strftime(make_timestamp(min(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') as start, count(*) as calls, round(count(*) filter (where passthrough = 0) / count(*) * 100, 1) as adoption from s group by session""",
    "stream_ledger": f"{_CALLS} t as (select category, count(*) as calls, cast(sum({SAVED}) as bigint) as saved from calls group by category) select * from t",
    "retention_exact": f"{_KEPT} select category, day, count(*) as n, min(timestamp) as first from kept group by category, day",
    "ledger_rollups": f"{_KEPT} select day, category, count(*) as calls, cast(sum(bytes_before) as bigint) as raw, cast(sum({SAVED}) as bigint) as saved from kept group by day, category",
}
