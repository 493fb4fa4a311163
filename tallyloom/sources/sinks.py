"""Writing the ledger and raw outputs, and letting old ones go.

A ledger is partitioned by day and batch. Each append is one batch, and writing a batch again replaces it, so that a batch delivered twice counts once. Appends never touch each other's partitions, nor does retention touch those of an append that runs meanwhile: it deletes whole days, and of the day that the cutoff falls into only the batches that it has seen.

Beside the rows a ledger has roll-ups: for each day and batch the sums by category, strategy and passthrough, written with the batch and corrected by retention. Reports add them up and don't read rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.ledger import saved_bytes
from tallyloom.sources.schema import CALLS

STREAM_LIMIT = 10 << 20
KEPT_RAW = 100
DEFAULT_DAYS = 90


#: Where roll-ups lie, below a ledger's folder; Spark's readers of the ledger pass over names that begin so.
ROLLUPS = "_rollups"
ROLLUP = T.StructType(
    [
        *[f for f in CALLS if f.name in ("category", "strategy", "passthrough")],
        *[T.StructField(name, T.LongType()) for name in ("calls", "raw", "saved", "first", "last")],
    ]
)
PLACES = T.StructType([T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())])


def _replace(rows: DataFrame, path: str) -> None:
    """Writes whole (day, batch) partitions in place of those that are there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def _rollup(rows: DataFrame) -> DataFrame:
    """Sums of the rows of each (day, batch), which merge by addition."""
    sums = [F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("bytes_before"), F.lit(0)).cast("bigint").alias("raw"), F.coalesce(F.sum(saved_bytes()), F.lit(0)).cast("bigint").alias("saved"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")]
    return rows.groupBy("category", "strategy", "passthrough", "day", "batch").agg(*sums)


def append_calls(calls: DataFrame, path: str, batch: str | None = None, settings: dict | None = None) -> str | None:
    """Appends to a ledger as one batch, with its roll-ups; gives the batch's name. Appending a batch again replaces it. With settings that switch tracking off nothing is written.

    Rows come first and roll-ups after them, so a batch that failed in between is mended by appending it again.
    """
    tracking = (settings or {}).get("tracking")
    if isinstance(tracking, dict) and not tracking.get("enabled", True):
        return None
    name = batch or f"b-{uuid.uuid4().hex}"
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", name):
        raise ValueError(f"not a name for a batch: {name!r}")
    _replace(calls.withColumns({"day": F.to_date(F.timestamp_seconds("timestamp")), "batch": F.lit(name)}), path)
    _replace(_rollup(ledger_batches(calls.sparkSession, path).where(F.col("batch") == name)), f"{path}/{ROLLUPS}")
    return name


def ledger_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ledger with their day and batch."""
    return spark.read.schema(T.StructType([*CALLS, *PLACES])).parquet(path)


def rollups(spark: SparkSession, path: str) -> DataFrame:
    """A ledger's roll-ups, one row for each day, batch, category, strategy and passthrough."""
    return spark.read.schema(T.StructType([*ROLLUP, *PLACES])).parquet(f"{path}/{ROLLUPS}")


def retention_days(value) -> int:
    """A setting's days: the default unless it is a whole number of 0 or more; 0 keeps all."""
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else DEFAULT_DAYS


def retained(calls: DataFrame, now: int, days: int = DEFAULT_DAYS) -> DataFrame:
    """What a ledger keeps; the filter prunes whole days where it is partitioned by day."""
    if days == 0:
        return calls
    cutoff = now - days * 86400
    rows = calls.where(F.col("timestamp") >= cutoff)
    return rows.where(F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(cutoff)))) if "day" in calls.columns else rows


def cut_bytes(text: Column, limit: int = STREAM_LIMIT, mark: str = "...(truncated)") -> Column:
    """At most `limit` bytes of UTF-8, cut between characters, and a mark if anything is gone."""
    raw = text.cast("binary")
    head = F.substring(raw, 1, limit)
    # a cut within a character leaves up to three bytes that can't be decoded
    tries = [F.try_validate_utf8(F.substring(head, F.lit(1), F.greatest(F.lit(limit - k), F.lit(0))).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.coalesce(*tries), F.lit(mark)))


def raw_records(captures: DataFrame, now: Column, limit: int = STREAM_LIMIT) -> DataFrame:
    """(name, value): JSON records of raw outputs under the name of their time and command."""
    command = F.sha1(F.array_join(F.concat(F.array("tool"), F.coalesce("args", F.array().cast("array<string>"))), " "))
    record = F.to_json(F.struct(command.alias("command"), cut_bytes(F.col("stdout"), limit).alias("stdout"), cut_bytes(F.col("stderr"), limit).alias("stderr"), F.col("exit_code")))
    return captures.select(F.concat(now.cast("string"), F.lit("_"), F.substring(command, 1, 8), F.lit(".log")).alias("name"), now.cast("bigint").alias("time"), record.alias("value"))


def newest(records: DataFrame, keep: int = KEPT_RAW) -> DataFrame:
    """The newest records. A top-k: each task keeps `keep` rows at most."""
    return records.orderBy(F.desc("time"), F.desc("name")).limit(keep)


def expired(records: DataFrame, keep: int = KEPT_RAW, by: list[str] | None = None) -> DataFrame:
    """Records beyond the newest, for each of `by`. Without it, the oldest of the newest is found by a top-k, and older ones are filtered: nothing is sorted in one task."""
    age = F.struct("time", "name")
    if by:
        rank = Window.partitionBy(*by).orderBy(F.desc("time"), F.desc("name"))
        return records.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") > keep).drop("rank")
    edge = newest(records, keep).agg(F.min(age).alias("edge"), F.count(F.lit(1)).alias("n_newest")).where(F.col("n_newest") == keep)
    return records.join(F.broadcast(edge), age < F.col("edge")).drop("edge", "n_newest")


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _edge_day(spark: SparkSession, cutoff: int) -> str:
    return spark.range(1).select(F.to_date(F.timestamp_seconds(F.lit(cutoff))).cast("string")).first()[0]


def drop_old_days(spark: SparkSession, path: str, now: int, days: int = DEFAULT_DAYS) -> list[str]:
    """Deletes the day folders of a ledger, and of its roll-ups, that `retained` reads nothing from; gives their names. Nothing is rewritten."""
    if days == 0:
        return []
    first, gone = _edge_day(spark, now - days * 86400), set()
    for place in (path, f"{path}/{ROLLUPS}"):
        where, store = _store(spark, place)
        for name in [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []:
            if name.startswith("day=") and name[4:] < first:
                store.delete(_store(spark, f"{place}/{name}")[0], True)
                gone.add(name)
    return sorted(gone)


def retain_rows(spark: SparkSession, path: str, now: int, days: int = DEFAULT_DAYS) -> list[str]:
    """Deletes exactly the rows before `now` less so many days: earlier days as folders, and of the cutoff's day the batches that lie before it; batches on both sides are rewritten without the old rows, and their roll-ups anew. Gives the names of the days and batches that it touched. Batches appended meanwhile stay as they are."""
    if days == 0 or not _store(spark, path)[1].exists(_store(spark, path)[0]):
        return []
    cutoff = now - days * 86400
    edge, touched = _edge_day(spark, cutoff), drop_old_days(spark, path, now, days)
    place = f"{path}/day={edge}"
    if not _store(spark, place)[1].exists(_store(spark, place)[0]):
        return touched
    day = ledger_batches(spark, path).where(F.col("day") == F.lit(edge).cast("date"))
    # one row for each append of one day
    ends = {r.batch: (r.first, r.last) for r in day.groupBy("batch").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).collect()}
    cut = sorted(b for b, (first, last) in ends.items() if first < cutoff <= last)
    if cut:
        _replace(day.where(F.col("batch").isin(cut) & (F.col("timestamp") >= cutoff)), path)
        _replace(_rollup(ledger_batches(spark, path).where((F.col("day") == F.lit(edge).cast("date")) & F.col("batch").isin(cut))), f"{path}/{ROLLUPS}")
    for batch in sorted(b for b, (_, last) in ends.items() if last < cutoff):
        for top in (path, f"{path}/{ROLLUPS}"):
            where, store = _store(spark, f"{top}/day={edge}/batch={batch}")
            store.delete(where, True)
        touched.append(f"day={edge}/batch={batch}")
    return touched + [f"day={edge}/batch={b}" for b in cut]


def clear(spark: SparkSession, path: str) -> None:
    """Deletes a ledger."""
    where, store = _store(spark, path)
    store.delete(where, True)
