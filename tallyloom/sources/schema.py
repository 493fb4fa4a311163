"""The three relations: captures, lines and the ledger of calls; reading them with old or foreign schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALLS = T.StructType(
    [
        T.StructField("command_hash", T.StringType()),
        T.StructField("command_text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("bytes_before", T.LongType()),
        T.StructField("bytes_after", T.LongType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("passthrough", T.IntegerType()),
        T.StructField("strategy", T.StringType()),
    ]
)
CAPTURES = T.StructType(
    [
        T.StructField("capture_id", T.LongType()),
        T.StructField("tool", T.StringType()),
        T.StructField("args", T.ArrayType(T.StringType())),
        T.StructField("stdout", T.StringType()),
        T.StructField("stderr", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
    ]
)
#: Columns that older ledgers lack, with what they then hold.
ADDED = {"command_text": "", "strategy": "", "passthrough": 0}


def empty(spark: SparkSession, schema: T.StructType = CALLS) -> DataFrame:
    return spark.createDataFrame([], schema)


def migrate(ledger: DataFrame) -> DataFrame:
    """A ledger with every column of CALLS. One that lacks a column without a default counts as empty."""
    have = set(ledger.columns)
    if any(f.name not in have and f.name not in ADDED for f in CALLS):
        return empty(ledger.sparkSession)
    return ledger.select(*[(F.coalesce(F.col(f.name), F.lit(ADDED[f.name])) if f.name in ADDED and f.name in have else F.col(f.name) if f.name in have else F.lit(ADDED[f.name])).cast(f.dataType).alias(f.name) for f in CALLS])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below a folder, written by sinks.append_calls; a missing one is empty."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except Exception as e:  # Spark reports a missing folder in several classes
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return empty(spark)
        raise
    return migrate(found)


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captures with universal newlines, as text capture gives them."""
    rows = spark.read.schema(CAPTURES).format(fmt).load(path)
    return rows.withColumns({c: universal_newlines(F.col(c)) for c in ("stdout", "stderr")})


def universal_newlines(text):
    return F.regexp_replace(text, "\r\n?", "\n")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files as they are: path, length and content, byte for byte."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source files as (path, ext, text)."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select("path", file_ext(F.col("path")).alias("ext"), "text")


def file_ext(path):
    """Lower-case extension with its dot; none for names that only start with one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
