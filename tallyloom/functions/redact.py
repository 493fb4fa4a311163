"""Secrets in captured output: lines and JSON keys that name one are dropped."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.guard import or_null, readable
from tallyloom.functions.rowwise import row_udf
from tallyloom.functions.text import join_lines, lines_of, run_lines

#: What a line or key that names a secret contains, in lower case.
SECRET_WORDS = ("secret", "token", "password", "accesskey", "credential", "aws_access_key_id", "aws_secret_access_key")
SECRET_PATTERN = "|".join(SECRET_WORDS)


def names_secret(text: Column) -> Column:
    return F.lower(text).rlike(SECRET_PATTERN)


def without_secret_lines(a: Column) -> Column:
    return F.filter(a, lambda x: ~names_secret(x))


def compact_infra(text: Column) -> Column:
    """Drops lines that name a secret, then counts repeats; blank lines are counted like others."""
    return join_lines(run_lines(without_secret_lines(lines_of(text)), " (x%d)", blanks=True))


def redact_map(m: Column) -> Column:
    """A flat map without its secret keys."""
    return F.map_filter(m, lambda k, _: ~names_secret(k))


def _pruned(value):
    if isinstance(value, dict):
        return {k: _pruned(v) for k, v in value.items() if not any(w in k.lower() for w in SECRET_WORDS)}
    return [_pruned(v) for v in value] if isinstance(value, list) else value


@row_udf(T.StringType())
@or_null
def _redact_json(text: str | None) -> str | None:
    """Null for what isn't JSON, or is nested deeper than can be followed."""
    return None if text is None else json.dumps(_pruned(json.loads(text.strip())), indent=2, sort_keys=True)


def compact_cloud(text: Column) -> Column:
    """JSON without secret keys at any depth, sorted and indented; other text as compact_infra. The depth of JSON is open, so this one is an Arrow UDF."""
    text = readable(text)
    return F.when(text.isNotNull(), F.coalesce(_redact_json(text), compact_infra(text)))
