"""Settings as JSON, merged with the defaults two levels deep, on any store that Spark reaches."""

from __future__ import annotations

import copy
import json

from pyspark.sql import SparkSession

#: The defaults of all settings.
DEFAULTS = {
    "tee": {"enabled": True, "mode": "failures", "dir": "~/.local/share/tallyloom/tee", "min_bytes": 0},
    "truncate": {"max_lines": 500, "max_line_chars": 300},
    "bypass_commands": [],
    "ignore_dirs": [".git", "node_modules", "target"],
    "ignore_files": ["*.lock"],
    "tracking": {"enabled": True, "history_days": 90},
}


def merged(loaded) -> dict:
    """What was loaded, completed by the defaults; sections are completed setting by setting. Anything but an object counts as nothing."""
    if not isinstance(loaded, dict):
        return copy.deepcopy(DEFAULTS)
    sections = {k: v | loaded[k] for k, v in DEFAULTS.items() if isinstance(v, dict) and isinstance(loaded.get(k), dict)}
    return copy.deepcopy(DEFAULTS | loaded | sections)


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(spark: SparkSession, settings: dict, path: str) -> None:
    where, store = _place(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray((json.dumps(settings, indent=2) + "\n").encode()))
    finally:
        out.close()


def load(spark: SparkSession, path: str) -> dict:
    """The settings of a file. A missing one is written with the defaults, a broken one counts as nothing."""
    where, store = _place(spark, path)
    if not store.exists(where):
        save(spark, DEFAULTS, path)
        return copy.deepcopy(DEFAULTS)
    stream = store.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return merged(json.loads(text))
    except ValueError:
        return copy.deepcopy(DEFAULTS)


def with_tracking(settings: dict, enabled: bool) -> dict:
    """Settings with calls being recorded, or not."""
    old = settings.get("tracking")
    return settings | {"tracking": (old if isinstance(old, dict) else {}) | {"enabled": enabled}}
