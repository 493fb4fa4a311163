import json
import random

from pyspark.sql import functions as F

from tallyloom.functions.rules import apply_rules
from tallyloom.operators import ruletable as T


def some_rule(rng):
    rule = {}
    for name, values in {
        "strip_lines_matching": [r"^a", r"\d+$", ""],
        "keep_lines_matching": [r"[ab]", r"\bx\b"],
        "replace": [{"pattern": r"(\w)(\w*)", "replacement": r"\2\1"}, {"pattern": "a", "replacement": "$1\\\\"}, {"pattern": "b"}],
        "max_lines": [0, 3, "4", -2],
        "tail_lines": [0, 2, -1],
        "strip_ansi": [True, False],
        "dedupe_lines": [True, False],
    }.items():
        if rng.random() < 0.3:
            rule[name] = rng.choice(values)
    return rule


def test_equals_rules_as_expressions(spark):
    rng = random.Random(0)
    rules = [(k, rng.choice(["t0", "t1", "t2", None]), some_rule(rng)) for k in range(12)]
    lines = ["a 1", "b", "x y", "", "abc 22", "\x1b[1mb\x1b[0m", "é", "b"]
    rows = [(i, f"t{i % 4}" if i % 7 else None, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, "t1", None), (61, "t0", "")]
    df = spark.createDataFrame([(*r, 5, "r") for r in rows], "capture_id int, tool string, stdout string, text int, rules string")
    table = spark.createDataFrame([(k, t, json.dumps(r)) for k, t, r in reversed(rules)], "pos int, match_command string, rule string")
    got = T.apply_rule_table(df, table)
    assert got.columns == df.columns
    as_columns = apply_rules(F.col("stdout"), F.col("tool"), [r | ({"match_command": t} if t else {}) for _, t, r in rules])
    want = df.select("capture_id", "tool", as_columns.alias("stdout"), "text", "rules")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_bad_rule_spoils_its_own_list_only(spark):
    df = spark.createDataFrame([(1, "good", "a\nb"), (2, "bad", "a\nb"), (3, "worse", "a\nb"), (4, "late", "a\nb"), (5, "unknown", "a\nb"), (6, "odd", "a\nb")], "capture_id int, tool string, stdout string")
    drop = '{"strip_lines_matching": "a"}'
    table = [(1, "good", drop), (1, "bad", drop), (2, "bad", '{"replace": {"pattern": "(", "replacement": ""}}'), (1, "worse", "no json"), (1, "late", drop), (2, "late", '{"replace": {"pattern": "(b)", "replacement": "\\\\2"}}'), (1, "unknown", '{"nope": 1}'), (None, "odd", drop), (9, "odd", None)]
    got = T.apply_rule_table(df, spark.createDataFrame(table, "pos int, match_command string, rule string"))
    assert {r.tool: r.stdout for r in got.collect()} == {"good": "b", "bad": "a\nb", "worse": "a\nb", "late": "a\nb", "unknown": "a\nb", "odd": "b"}


def test_empty_tables_and_odd_bytes(spark):
    df = spark.createDataFrame([(1, "t", "a\nb"), (2, "t", "x")], "capture_id int, tool string, stdout string").withColumn("stdout", F.when(F.col("capture_id") == 2, F.unhex(F.lit("41FF")).cast("string")).otherwise(F.col("stdout")))
    none = spark.createDataFrame([], "pos int, match_command string, rule string")
    table = none.unionByName(spark.createDataFrame([(1, None, '{"max_lines": 1}')], none.schema))
    assert T.apply_rule_table(df.limit(0), table).count() == 0
    assert T.apply_rule_table(df, none).where("capture_id = 1").first().stdout == "a\nb"
    got = {r.capture_id: r.h for r in T.apply_rule_table(df, table).select("capture_id", F.hex("stdout").alias("h")).collect()}
    assert got == {1: "61", 2: "41FF"}
    assert len(T.changed("a\n" * 300_000, json.dumps(['{"dedupe_lines": true}']))) == 2
