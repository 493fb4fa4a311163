"""What the operators share: working folders, table reading, byte-exact native text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.rowwise import SLICE_BYTES, bound_batches
from tallyloom.sources import store

#: The ASCII white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables. It goes when the interpreter ends, as results are read from it lazily."""
    bound_batches(spark)
    return store.workspace(spark, label)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    store.remove(spark, path)


def save(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and no executor's loss matters."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def arrow_rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of one row or of at most max_bytes in a column of texts, bytes or 32-bit lists, without copies."""
    for batch in batches:
        values = batch.column(column)
        size = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
