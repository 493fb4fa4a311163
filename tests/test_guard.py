import pytest
from pyspark.sql import functions as F

from tallyloom.functions import classify as C
from tallyloom.functions import outline as O
from tallyloom.functions import redact as D
from tallyloom.functions import reports as R
from tallyloom.functions.rules import apply_rules, compile_rule
from tallyloom.operators import lines, route

def bad():
    return F.concat(F.lit("x"), F.unhex(F.lit("FF")).cast("string"))


def capture(spark, tool, args, out, **more):
    df = spark.createDataFrame([(1, tool, args, out, "", 0)], "capture_id bigint, tool string, args array<string>, stdout string, stderr string, exit_code int")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.mark.parametrize(
    "tool, args, out",
    [
        ("pytest", [], "99999999999 passed"),
        ("pytest", [], "2147483647 failed, 1 error"),
        ("cargo", ["test"], "2147483647 passed; 0 failed\n1 passed; 0 failed"),
        ("cargo", ["test"], "99999999999 passed; 0 failed"),
        ("cargo", ["clippy"], "error: x\ndue to 99999999999 previous errors"),
        ("jest", [], "Tests: 1 failed, 99999999999 passed"),
        ("vitest", [], "Tests 99999999999 failed | 1 passed"),
    ],
)
def test_numbers_beyond_all_measure_give_raw_unrecorded_output(spark, tool, args, out):
    r = route.compact(capture(spark, tool, args, out)).first()
    assert (r.output, r.recorded, r.passthrough) == (out, False, 0)


def test_bytes_that_are_no_text(spark):
    one = spark.range(1)
    got = one.select(D.compact_cloud(bad()).alias("a"), O.outline(bad(), F.lit(".py")).alias("b"), C.rewrite(F.concat(F.lit("git status "), bad())).alias("c"), C.hook_answer(bad()).alias("d")).first()
    assert tuple(got) == (None, None, None, None)


def test_nesting_beyond_all_measure(spark):
    deep = "[" * 200_000 + "]" * 200_000
    r = route.compact(capture(spark, "aws", ["s3"], deep)).first()
    assert r.output == deep and r.recorded
    assert spark.range(1).select(C.hook_answer(F.lit('{"tool_name": ' * 50_000)).alias("a")).first().a is None


def test_rules_that_cannot_run_change_nothing(spark):
    for rule in ({"replace": {"pattern": "(a)", "replacement": r"\2"}}, {"replace": {"pattern": "a", "replacement": r"\g<n>"}}, {"replace": {"pattern": "(", "replacement": ""}}):
        with pytest.raises(Exception):  # noqa: B017
            compile_rule(rule)
        assert spark.range(1).select(apply_rules(F.lit("a b"), F.lit("t"), [{"max_lines": 0}, rule]).alias("t")).first().t == "a b"
    assert spark.range(1).select(apply_rules(F.lit("ab"), F.lit("t"), [{"replace": {"pattern": "(?P<n>a)", "replacement": r"\g<n>\1"}}]).alias("t")).first().t == "aab"


def test_no_arguments_and_no_names(spark):
    none = F.array().cast("array<string>")
    assert spark.range(1).select(C.detect_runner(none).alias("r")).first().r is None
    files = spark.createDataFrame([(1, ""), (1, "/"), (1, "a/b")], "id int, path string")
    assert [r.line for r in lines.tree_rows(files, "id", F.col("path")).orderBy("pos").collect()] == [". (0)", "  a (1)", "    b"]


def test_columns_of_the_input_survive(spark):
    rows = spark.createDataFrame([("a", 2, 98, "n"), ("a", 1, 99, "m")], "k string, o int, rank int, n_group string")
    got = lines.first_k(rows, ["k"], ["o"], 1).collect()
    assert [r.asDict() for r in got] == [{"k": "a", "o": 1, "input_rank": 99, "input_n_group": "m", "rank": 1, "n_group": 2}]
    assert [r.input_rank for r in lines.first_k(rows, ["k"], ["rank"], 1).collect()] == [98]
    df = capture(spark, "cat", ["f"], "a\na\n", strategy="mine", way="w", output="o", recorded=7, input_way="i", compacted="c")
    r = route.compact(df).first().asDict()
    assert r["strategy"] == "cat" and r["output"] == "a  [×2]\n" and r["recorded"] is True
    assert (r["input_strategy"], r["input_input_way"], r["input_way"], r["input_output"], r["input_recorded"], r["input_compacted"]) == ("mine", "w", "i", "o", 7, "c")


def test_reports_with_large_but_readable_counts(spark):
    text = F.lit("2147483647 failed, 5 passed")
    assert spark.range(1).select(R.test_text(R.pytest_report(text)).alias("t")).first().t == "2147483647 failed, 5 passed"


def test_python_outline():
    text = '#!/usr/bin/env python\n"""Doc\nstring."""\nimport x\n\n# note\nclass A:\n    """Doc."""\n    y = 1\n\n    @property\n    def f(self, a: int = 1): return a\n\n    async def g(\n        self,\n    ): # note\n        if y:\n            def inner():\n                pass\nif x:\n    z = 2\n    def h(): # one: two\n        w = 3\n    v = 4\n\'\'\'never closed\ndef gone(): pass'
    assert O.python_outline(text).split("\n") == ["#!/usr/bin/env python", "import x", "class A:", "    @property", "    def f(self, a: int = 1):", "    async def g(", "            def inner():", "if x:", "    z = 2", "    def h(): # one:", "    v = 4"]
    assert O.python_outline("") == O.python_outline('"""x') == O.python_outline("  # x\n#!x") .replace("#!x", "") == ""
    assert O.enclosed([0, 4, 8, 4, 0, 2, 0], [True, False, True, False, False, False, True]) == [False, True, True, True, False, False, False]
