"""Folders for intermediate tables on the store that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application; made only where none is named and all work is on this machine.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without one, a local session gets a folder of its own and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="tallyloom-")
    return _own[context.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; one that is gone, or whose session has ended, is left."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder's path. It goes when the interpreter ends, as results are read from it lazily."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back: lineage ends here, and a lost executor costs a read."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
