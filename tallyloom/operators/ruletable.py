"""User rules as a table: any number of rules for any number of tools, joined to captures by tool.

A rule is a row (pos, match_command, rule): its place among all rules, the tool it is for (null: every tool), and its steps as JSON. Rules are grouped to one list a tool, in order, with those for every tool in between; captures are joined to the list of their tool, whichever way Spark finds best for its size, so that a tool with very many captures is split like any skewed join. Workers compile each list once and remember it. Patterns are Python's own here.

Defined results: a null text stays null; captures of tools without rules, or without a tool, get the rules for every tool; a list with a rule that can't be read, compiled or run changes nothing, and no other list is touched; rules of one place are taken in order of their JSON; empty tables are fine; other columns of the captures are kept, and only the text is changed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.guard import readable
from tallyloom.functions.rules import KEYS, STEPS
from tallyloom.functions.text import ANSI

#: Lists of rules that a worker remembers in compiled form.
REMEMBERED = 1000
#: A field that keeps a struct from being empty.
UNUSED = "_"
#: Bytes of text that a worker turns into objects at a time (one text may be longer).
SLICE_BYTES = 2 << 20


def _step(name: str, value) -> Callable[[list[str]], list[str]] | None:
    """One step on lines; None for a step that is switched off."""
    if name in ("strip_lines_matching", "keep_lines_matching"):
        found, wanted = re.compile(value).search, name.startswith("keep")
        return lambda lines: [x for x in lines if (found(x) is not None) == wanted]
    if name == "replace":
        pattern, by = re.compile(value["pattern"]), value.get("replacement", "")
        pattern.sub(by, "")
        return lambda lines: [pattern.sub(by, x) for x in lines]
    if name == "max_lines":
        return lambda lines, n=int(value): lines[:n]
    if name == "tail_lines":
        return lambda lines, n=int(value): lines[-n:]
    if name == "strip_ansi":
        return (lambda lines, codes=re.compile(ANSI): [codes.sub("", x) for x in lines]) if value else None
    return (lambda lines: list(dict.fromkeys(lines))) if value else None


@lru_cache(maxsize=REMEMBERED)
def compiled(rules: str) -> list[Callable] | None:
    """The steps of a JSON list of rules, in order; None if one of them can't be used."""
    try:
        parsed = [json.loads(r) for r in json.loads(rules)]
        if any(not isinstance(r, dict) or set(r) - KEYS for r in parsed):
            return None
        return [step for r in parsed for name in STEPS if name in r and (step := _step(name, r[name])) is not None]
    except Exception:
        return None


def changed(text: str, rules: str | None) -> str:
    steps = compiled(rules) if rules else None
    if not steps:
        return text
    try:
        lines = text.split("\n")
        for step in steps:
            lines = step(lines)
        return "\n".join(lines)
    except Exception:
        return text


def lists_by_tool(rules: DataFrame) -> tuple[DataFrame, str]:
    """(tool, rules): the JSON list of each tool that a rule names; and that of all other tools, the rules for every tool, which are a person's settings and few."""
    row = lambda of: F.struct(F.col(f"{of}pos").alias("pos"), F.col(f"{of}rule").alias("rule"))
    in_order = lambda items: F.to_json(F.transform(F.array_sort(items), lambda r: r["rule"]))
    valid = rules.where("rule is not null").select("pos", "match_command", "rule")
    general = valid.where("match_command is null").agg(F.collect_list(row("")).alias("items")).first().items
    general = sorted((r.pos is not None, r.pos or 0, r.rule) for r in general)
    ready = F.array(*[F.struct(F.lit(pos if known else None).cast(rules.schema["pos"].dataType).alias("pos"), F.lit(rule).alias("rule")) for known, pos, rule in general])
    own = valid.where("match_command is not null").groupBy(F.col("match_command").alias("tool")).agg(F.collect_list(row("")).alias("items"))
    both = F.concat("items", ready) if general else F.col("items")
    return own.select("tool", in_order(both).alias("rules")), json.dumps([rule for _, _, rule in general])


def apply_rule_table(captures: DataFrame, rules: DataFrame, tool_col: str = "tool", text_col: str = "stdout") -> DataFrame:
    """captures with their texts changed by the rules for their tools."""
    lists, general = lists_by_tool(rules)
    named = lists.select(F.col("tool").alias("of_tool"), F.col("rules").alias("of_rules"))
    rest = F.struct(*[F.col(f"`{c}`") for c in captures.columns if c != text_col], F.lit(0).alias(UNUSED)).alias("rest")
    text = F.col(f"`{text_col}`")
    rows = captures.select(rest, text.alias("text"), F.col(f"`{tool_col}`").alias("is_tool"))
    joined = rows.join(named, F.col("is_tool") == F.col("of_tool"), "left")
    # bytes that are no text pass by as they are
    text = readable(F.col("text"))
    ready = joined.select("rest", text.alias("text"), F.coalesce("of_rules", F.lit(general)).alias("rules"), F.when(text.isNull(), F.col("text")).alias("odd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size, to = 0, at
                while to < batch.num_rows and (to == at or size < SLICE_BYTES):
                    size += batch.column(1)[to].as_buffer().size if batch.column(1)[to].is_valid else 0
                    to += 1
                part = batch.slice(at, to - at)
                texts = [None if t is None else changed(t, r) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(3)], ["rest", "text", "odd"])
                at = to

    done = ready.mapInArrow(run, T.StructType([ready.schema["rest"], T.StructField("text", T.StringType()), T.StructField("odd", T.StringType())]))
    return done.select(*[(F.coalesce("text", "odd") if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in captures.columns])
