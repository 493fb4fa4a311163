import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import PythonEvalType

from tallyloom.functions import classify as C
from tallyloom.functions import outline as O
from tallyloom.functions import redact as D
from tallyloom.functions.guard import or_null
from tallyloom.functions.rowwise import BATCH_BYTES, BATCH_SETTING, row_udf, slice_ends
from tallyloom.operators import route
from tallyloom.plans import routing, texts


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def ask(command, **more):
    return json.dumps({"tool_name": "Bash", "tool_input": {"command": command} | more})


def test_answers_take_one_worker_a_task(spark, tmp_path):
    events = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(1, None, 7, "view", 1.0, ""), (2, None, 8, "click", 1.0, ""), (5, None, 9, "view", 1.0, "")], events).write.parquet(f"{tmp_path}/events.parquet")
    got = texts.hook_answers(spark, str(tmp_path))
    assert sorted((r.event_id, json.loads(r.answer)["hookSpecificOutput"]["updatedInput"]) for r in got.collect()) == [(1, {"command": "tally cat f7.txt", "n": 1}), (2, {"command": "tally git log -n 8", "n": 2})]
    assert python_steps(got) == 1


def test_answers_as_rows(spark):
    commands = ["git status", "rm x", "cat 'open", "cat a; ls", "tally git status", "", "cat " + "x" * 4092, "cat " + "x" * 4093, "ls -la src", "git branch new", "cat \ud800", "\ud800 x"]
    rows = spark.createDataFrame([*enumerate(map(ask, commands)), (90, None), (91, "{"), (92, ask("jest", list=[1, None], inner={"k": "é"})), (93, ask("jest").replace("Bash", "Read"))], "k int, message string")
    got = {r.k: json.loads(r.answer)["hookSpecificOutput"]["updatedInput"] for r in C.answers(rows, F.col("message"), "go ").collect()}
    assert got == {k: {"command": "go " + commands[k]} for k in (0, 6, 8, 10)} | {92: {"command": "go jest", "list": [1, None], "inner": {"k": "é"}}}
    assert rows.select(C.hook_answer(F.col("message"), "go ").alias("a")).where("a is null").count() == len(commands) + 4 - len(got)


@pytest.mark.parametrize("udf, rest", [(O._outline, [".py"]), (O._outline, [".rs"]), (C._tokens, []), (C._asked, ["tally ", "c"]), (D._redact_json, [])])
def test_workers_make_objects_of_few_rows_at_a_time(udf, rest):
    text = {"_asked": ask("cat f", x="x = 1 " * 3000), "_redact_json": json.dumps(["x = 1"] * 2000)}.get(udf.func.__name__, "x = 1\n" * 3000)
    columns = [pa.array([c] * 800) for c in [text, *rest]]
    assert udf.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    tracemalloc.start()
    out = udf.func(*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 800 and out.null_count == 0 and len(set(map(str, out.to_pylist()))) == 1
    assert columns[0].nbytes > 12e6 and peak < 11e6


def test_slices(spark):
    texts_of = lambda *sizes: pa.array([None if n is None else "x" * n for n in sizes], pa.string())
    assert slice_ends((texts_of(3, 3, 3, 20, None, 9, 1),), 10) == [3, 4, 7]
    assert slice_ends((texts_of(3, 3, None), texts_of(4, 3, 4)), 10) == [1, 3]
    assert slice_ends((texts_of(3, 2, None), texts_of(3, None, 4)), 12) == [3]
    assert slice_ends((texts_of(),), 10) == []
    length = row_udf(T.LongType(), 10)(or_null(lambda a, b: len(a) + len(b) if a != "bad" else 1 // 0))
    rows = spark.createDataFrame([(k, "bad" if k % 5 == 0 else "é" * k, None if k % 7 == 0 else "b") for k in range(40)], "k int, a string, b string")
    assert {r.k: r.n for r in rows.select("k", length("a", "b").alias("n")).collect()} == {k: None if k % 5 == 0 or k % 7 == 0 else k + 1 for k in range(40)}
    assert rows.where("k < 0").select(length("a", "b").alias("n")).collect() == []


@pytest.mark.parametrize("query", ["outlines", "json_redacted", "hook_answers", "classify_command", "route"])
def test_queries_bound_what_arrow_holds(spark, query):
    probe = F.arrow_udf(batch_size, T.LongType())
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.unset(BATCH_SETTING)
        if query == "route":
            route.compact(spark.createDataFrame([(1, "git", ["log"], "", "", 0)], "capture_id bigint, tool string, args array<string>, stdout string, stderr string, exit_code int"))
        else:
            (texts.QUERIES | routing.QUERIES)[query](spark, "/root/testdata/sf0.001")
        most = spark.range(0, 2000, 1, 1).select(probe(F.repeat(F.lit("x"), F.lit(20_000) + F.col("id").cast("int") % 2)).alias("n")).agg(F.max("n")).first()[0]
        assert most <= BATCH_BYTES + 100_000
    finally:
        spark.conf.set(BATCH_SETTING, before)


def batch_size(texts: pa.Array) -> pa.Array:
    return pa.array([sum(len(x.as_py()) for x in texts)] * len(texts), pa.int64())
