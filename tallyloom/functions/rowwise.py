"""Python functions over rows as Arrow UDFs that hold few rows as Python objects.

Spark's own UDFs over rows turn a whole batch into Python objects, all arguments and results at once: up to 10,000 rows or 64 MB. Here a batch is worked on in slices, and `bound_batches` bounds what Arrow holds of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of all arguments that become objects at a time (one row may be longer).
SLICE_BYTES = 2 << 20
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row) in this session, unless it has a bound of its own: executors hold several at a time."""
    if spark.conf.get(BATCH_SETTING, None) in (None, "64MB"):
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def slice_ends(columns: tuple[pa.Array, ...], max_bytes: int = SLICE_BYTES) -> list[int]:
    """Where slices of one row or of at most max_bytes of text end."""
    ends = np.cumsum(sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    out = [0]
    while out[-1] < len(ends):
        out.append(max(out[-1] + 1, int(np.searchsorted(ends, (ends[out[-1] - 1] if out[-1] else 0) + max_bytes, "right"))))
    return out[1:]


def row_udf(kind: T.DataType, max_bytes: int = SLICE_BYTES) -> Callable:
    """Makes a function of texts a UDF."""

    def made(f: Callable):
        arrow_kind = to_arrow_type(kind)

        def run(*columns: pa.Array) -> pa.Array:
            parts, at = [], 0
            for to in slice_ends(columns, max_bytes):
                rows = zip(*(c.slice(at, to - at).to_pylist() for c in columns), strict=True)
                parts.append(pa.array([f(*row) for row in rows], arrow_kind))
                at = to
            return pa.concat_arrays(parts) if parts else pa.array([], arrow_kind)

        run.__name__ = f.__name__
        return F.arrow_udf(run, kind)

    return made
