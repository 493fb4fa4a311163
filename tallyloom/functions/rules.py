"""User rules: a list of steps on lines, checked on the driver and compiled into one column expression."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.arrays import let
from tallyloom.functions.text import dedupe_lines, join_lines, lines_of, strip_ansi

#: The keys of a rule. Whatever their order in the rule, steps run in this one.
STEPS = ("strip_lines_matching", "keep_lines_matching", "replace", "max_lines", "tail_lines", "strip_ansi", "dedupe_lines")
KEYS = frozenset(STEPS) | {"match_command"}


class UnknownKey(ValueError):
    pass


def parse_rules(text: str | None) -> list[dict]:
    """Rules from JSON text; anything that isn't a list of objects gives none, an unknown key is an error."""
    try:
        data = json.loads(text) if text else []
    except ValueError:
        return []
    rules = [r for r in data if isinstance(r, dict)] if isinstance(data, list) else []
    for rule in rules:
        if unknown := sorted(set(rule) - KEYS):
            raise UnknownKey(", ".join(unknown))
    return rules


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java's engine, with Unicode classes. Constructs that differ are refused."""
    re.compile(pattern)
    if re.search(r"\(\?P=|\(\?\(|\(\?[aLu]", pattern):
        raise ValueError(f"not supported: {pattern}")
    return "(?U)" + re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern.replace("(?P<", "(?<"))


def java_replacement(replacement: str) -> str:
    """Group references of Python as those of Java."""

    def one(m: re.Match) -> str:
        if m[0] == "$":
            return r"\$"
        if m[1]:
            return f"${{{m[1]}}}" if not m[1].isdigit() else f"${m[1]}"
        if m[2]:
            return f"${m[2]}"
        return {"\\n": "\n", "\\t": "\t"}.get(m[0], "\\\\" if m[0] == "\\\\" else m[0])

    return re.sub(r"\\g<(\w+)>|\\(\d)|\\.|\$", one, replacement)


def _head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n) if n >= 0 else let(a, lambda b: F.slice(b, 1, F.greatest(F.size(b) + n, F.lit(0))))


def _tail(a: Column, n: int) -> Column:
    """The last n; all for 0; without the first -n for negative n."""
    if n == 0:
        return a
    start = (lambda b: F.greatest(F.size(b) - n, F.lit(0))) if n > 0 else (lambda b: F.least(F.size(b), F.lit(-n)))
    return let(a, lambda b: F.slice(b, start(b) + 1, F.size(b)))


def _step(name: str, value) -> object:
    if name in ("strip_lines_matching", "keep_lines_matching"):
        pattern, keep = java_pattern(value), name.startswith("keep")
        return lambda a: F.filter(a, lambda x: x.rlike(pattern) if keep else ~x.rlike(pattern))
    if name == "replace":
        if not isinstance(value, dict) or "pattern" not in value:
            raise ValueError("replace needs a pattern")
        re.compile(value["pattern"]).sub(value.get("replacement", ""), "")  # refuses groups that the pattern lacks
        pattern, by = java_pattern(value["pattern"]), java_replacement(value.get("replacement", ""))
        return lambda a: F.transform(a, lambda x: F.regexp_replace(x, pattern, by))
    if name in ("max_lines", "tail_lines"):
        n, take = int(value), _head if name == "max_lines" else _tail
        return lambda a: take(a, n)
    if not value:
        return lambda a: a
    return (lambda a: F.transform(a, strip_ansi)) if name == "strip_ansi" else dedupe_lines


def compile_rule(rule: dict):
    """Lines -> lines. Raises ValueError for a value that can't be used."""
    steps = [_step(name, rule[name]) for name in STEPS if name in rule]
    return lambda a: reduce(lambda x, f: f(x), steps, a)


def apply_rules(text: Column, tool: Column, rules: list[dict]) -> Column:
    """The text after every rule for its tool, in order. If a rule has a bad value, texts stay as they are, as they do where a rule can't run."""
    try:
        compiled = [(r.get("match_command"), compile_rule(r)) for r in rules]
    except (ValueError, TypeError, IndexError, re.error):
        return text
    for match, change in compiled:
        text = _where_tool(text, tool, match, change)
    return text


def _where_tool(text: Column, tool: Column, match: str | None, change) -> Column:
    """The changed text if the rule is for the tool. The text is named first, as it is used twice."""
    changed = lambda t: join_lines(change(lines_of(t)))
    return changed(text) if match is None else let(text, lambda t: F.when(tool == match, changed(t)).otherwise(t))
