"""What keeps one row's failure from failing the job: functions that give null instead of an error.

A parser that can't work on a capture gives null, and the router then shows the raw output and records nothing. Column expressions do so by their try_ forms; Python functions by `or_null`; texts that aren't UTF-8, which Arrow would refuse, are kept from Python by `readable`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_null(f: Callable) -> Callable:
    """f, giving null where it raises an error over its row."""

    @wraps(f)
    def guarded(*values):
        try:
            return f(*values)
        except Exception:
            return None

    return guarded


def readable(text: Column) -> Column:
    """The text if it is valid UTF-8, else null."""
    return F.when(F.is_valid_utf8(text), text)
