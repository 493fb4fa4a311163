import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import accounting, ledger, lines, route, sessions
from tallyloom.sources import schema, sinks

T1 = 1_700_000_000


def calls(spark, rows):
    """rows of (category, before, after, exit, timestamp, passthrough, strategy, command)."""
    filled = [(*r, *(0, "", "")[len(r) - 5 :]) for r in rows]
    return spark.createDataFrame([("h", r[7], r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in filled], schema.CALLS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_totals(spark):
    df = calls(spark, [("git", 10, 5, 0, T1), ("git", 5, 10, 0, T1), ("run", 100, 40, 0, T1)])
    assert rows(ledger.totals(df)) == [(65, 3, 115, 16, 56.5)]
    assert rows(ledger.top_saved(df)) == [("run", 60), ("git", 5)]
    assert rows(ledger.top_calls(df)) == [("git", 2), ("run", 1)]
    assert rows(ledger.strategy_breakdown(df)) == []
    report = ledger.total_report(df).first()
    assert [tuple(x) for x in report.top_saved] == [("run", 60), ("git", 5)] and report.saved == 65
    assert rows(ledger.totals(schema.empty(spark))) == [(0, 0, 0, 0, 0.0)]
    assert ledger.total_report(schema.empty(spark)).first().top_calls == []


def test_days_and_breakdown(spark):
    df = calls(spark, [("git", 20, 10, 0, T1), ("run", 50, 30, 0, T1 + 86400)])
    assert [r[1] for r in rows(ledger.daily_saved(df))] == [10, 20]
    assert [r[2] for r in rows(ledger.savings_graph(df))] == ["#" * 5, "#" * 10]
    df = calls(spark, [("git", 100, 40, 0, T1, 0, "git.status"), ("git", 80, 30, 0, T1, 0, "git.diff"), ("ls", 30, 10, 0, T1, 0, "ls")])
    got = rows(ledger.strategy_breakdown(df))
    assert got[0] == ("git.status", 60, 1, 46.2) and len(got) == 3


def test_sessions(spark):
    df = calls(spark, [("a", 1, 1, 0, T1), ("a", 1, 1, 0, T1 + 1000, 1), ("a", 1, 1, 0, T1 + 100000), ("a", 1, 1, 0, T1 + 101000)])
    assert [r[2] for r in rows(sessions.sessions(df))] == [50.0, 100.0]
    edge = calls(spark, [("a", 1, 1, 0, t) for t in (0, 1800, 3601)])
    assert [r[1] for r in rows(sessions.sessions(edge))] == [2, 1]
    rng = random.Random(1)
    for spread in (2_000, 40_000, 600_000):
        times = sorted(rng.randrange(spread * 20) for _ in range(300))
        cut = [i for i in range(len(times)) if i == 0 or times[i] - times[i - 1] > 1800] + [len(times)]
        want = [(times[a], times[b - 1], b - a) for a, b in zip(cut, cut[1:], strict=False)]
        got = sessions.spans(calls(spark, [("a", 1, 1, 0, t) for t in times])).select("first", "last", "calls")
        assert sorted(rows(got)) == want


def test_insights(spark):
    data = [("git", 10, 5, 0, T1, 0, "", "git status")] * 3 + [("git", 1, 1, 0, T1, 0, "", "git log")] + [("pytest", 1, 1, 1, T1, 0, "", "pytest x"), ("pytest", 1, 1, 2, T1 - 5, 0, "", "pytest x")]
    data += [("docker", 9, 9, 0, T1, 1, "", "docker ps")] + [("cat", 1, 1, 0, T1, 0, "", "cat f.txt")] * 3 + [("cat", 1, 1, 0, T1 - 8 * 86400, 0, "", "cat g")] * 5 + [("x", 1, 1, 0, T1, 1)]
    parts = ledger.insights(calls(spark, data), T1)
    assert rows(parts["repeated"])[0] == ("git status", 3, 15)
    assert rows(parts["failing"]) == [("pytest x", 2, 2)]
    assert rows(parts["passthrough"]) == [("docker ps", 1, 9)]
    assert [r[0] for r in rows(parts["suggestions"])] == sorted([ledger.HINT_LOG + "git log", ledger.HINT_CAT % (3, "f.txt")])
    assert [r[0] for r in rows(ledger.discover(calls(spark, [("docker", 1, 1, 0, T1, 1)] * 3 + [("gh", 1, 1, 0, T1, 1)] * 2 + [("git", 1, 1, 0, T1, 1), ("git", 1, 1, 0, T1)])))] == ["docker", "gh", "git"]


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert schema.read_ledger(spark, path).count() == 0
    old, new = ("a", 9, 1, 0, T1 - 91 * 86400), ("b", 9, 1, 0, T1)
    sinks.append_calls(calls(spark, [old, new]), path)
    sinks.append_calls(calls(spark, [new]), path)
    back = schema.read_ledger(spark, path)
    assert back.schema.simpleString() == schema.CALLS.simpleString() and back.count() == 3
    kept = sinks.retained(spark.read.parquet(path), T1)
    assert [r.category for r in kept.collect()] == ["b", "b"]
    assert sinks.retained(back, T1, 0).count() == 3
    assert [sinks.retention_days(x) for x in (5, 0, -1, "7", None, True)] == [5, 0, 90, 90, 90, 90]
    legacy = calls(spark, [new]).drop("command_text", "strategy")
    assert rows(schema.migrate(legacy).select("command_text", "strategy")) == [("", "")]
    assert schema.migrate(spark.range(3)).count() == 0


def test_raw_records(spark):
    df = spark.createDataFrame([(1, "git", ["log"], "é" * 10, "", 1)], schema.CAPTURES)
    record = sinks.raw_records(df, F.lit(T1), limit=5).first()
    assert record.name.startswith(f"{T1}_") and '"stdout":"éé...(truncated)"' in record.value
    many = spark.range(150).select(F.col("id").alias("time"), F.col("id").cast("string").alias("name"))
    assert min(r.time for r in sinks.newest(many).collect()) == 50 and sinks.expired(many).count() == 50
    wanted = lambda **k: spark.range(1).select(accounting.tee_wanted(F.lit(k.pop("code", 1)), F.lit(10), **k)).first()[0]
    assert wanted() and not wanted(code=0) and wanted(code=0, mode="always") and wanted(code=0, enabled=False, policy="always")
    assert not wanted(enabled=False) and not wanted(min_bytes=11) and not wanted(no_match=F.lit(True))


def test_tree_and_first_k(spark):
    files = spark.createDataFrame([(1, p) for p in ("b/x.py", "a.txt", "b/c/y.py", "b/a.pyc", ".git/h", "z/q")], "id int, path string")
    got = rows(lines.tree_rows(files, "id", F.col("path"), [".git"], ["*.pyc"]).orderBy("pos"))
    assert [r[2] for r in got] == [". (1)", "  a.txt", "  b (1)", "    x.py", "    c (1)", "      y.py", "  z (1)", "    q"]
    many = spark.range(205).select(F.lit(1).alias("id"), F.format_string("f%03d", "id").alias("path"))
    got = rows(lines.tree_rows(many, "id", F.col("path")).orderBy("pos"))
    assert len(got) == 200 and got[-1][2] == "... (7 more)"
    for glob, name, want in (("*.py", "a.py", True), ("*.py", "a.pyc", False), ("a?[!b-d].x", "azq.x", True), ("a?[!b-d].x", "azc.x", False), ("[a", "[a", True)):
        assert spark.range(1).select(F.lit(name).rlike(lines.glob_pattern(glob))).first()[0] is want


def test_line_rows(spark):
    df = spark.createDataFrame([(1, "a\na\n\n\nb\na"), (2, ""), (3, None)], "id int, t string")
    assert rows(lines.run_rows(df, "id", F.col("t")).where("id = 1")) == [(1, 0, "a", 2), (1, 1, "", 2), (1, 2, "b", 1), (1, 3, "a", 1)]
    exploded = lines.explode_lines(df, "id", F.col("t"))
    assert {r.id: r.text for r in lines.implode_lines(exploded, "id").collect()} == {1: "a\na\n\n\nb\na", 2: ""}
    cut = lines.run_rows(df, "id", F.col("t"))
    assert cut.where("id = 1").agg(F.sum("n")).first()[0] == 6


def test_routing_of_listings(spark):
    many = "".join(f"n{i:02d}\n" for i in range(31))
    data = [
        (1, [], "b\nA\nd\n", 0, ["d"]), (2, ["p/"], "x\n", 0, []), (3, ["p"], many, 0, ["n30", None]), (4, ["p", "q"], "p:\nx\n", 0, []), (5, ["p"], "x\n", 2, []),
        (6, ["f"], "f\n", 0, None), (7, None, "", 0, []), (8, ["-Z"], "x\n", 0, []), (9, ["-1"], "x\nx\n", 0, ["x"]),
    ]
    df = spark.createDataFrame(data, "capture_id bigint, args array<string>, stdout string, exit_code int, directories array<string>").selectExpr("capture_id", "'ls' as tool", "args", "stdout", "'' as stderr", "exit_code", "directories")
    got = {r.capture_id: r for r in accounting.account(route.compact(df)).collect()}
    assert {k: r.strategy for k, r in got.items()} == {k: "ls" if k in (1, 2, 3, 7, 9) else "passthrough" for k in range(1, 10)}
    assert got[1].output == "./ (3)\n  d\n  A\n  b" and got[2].output == "p/ (1)\n  x" and got[7].output == "./ (0)"
    assert got[3].output == "p/ (31)\n  n30\n" + "".join(f"  n{i:02d}\n" for i in range(10)) + "  ... (20 more)"
    assert (got[1].bytes_before, got[1].bytes_after) == (6, len(got[1].output) + 1) and got[6].output == "f\n"
    assert route.compact(df.drop("directories")).where("capture_id = 1 and strategy = 'passthrough'").count() == 1


def test_routing(spark):
    big = "".join(f"f:hit {i}\n" for i in range(300))
    data = [
        (1, "git", ["status"], "?? a\n", "", 0), (2, "git", ["status", "-s"], "?? a\n", "", 0), (3, "git", ["push"], "long text", "", 0),
        (4, "grep", ["x"], "", "", 1), (5, "grep", ["-c", "x"], "9\n", "", 0), (6, "grep", ["x", "."], big, "", 0),
        (7, "pytest", [], "1 passed", "", 0), (8, "pytest", [], "", "e", 2), (9, "run", ["make"], "x\nx\n", "", 0),
        (10, "run", ["make"], "lost", "bad", 2), (11, "cat", ["f"], "y\ny\n", "", 0), (12, "aws", ["s3"], '{"token": 1}', "", 0),
        (13, "read", ["m.py", "--level", "minimal"], "# c\nx = 1", "", 0), (14, "smart", ["m.py"], "def f(): pass", "", 0),
        (15, "nope", None, "as is", "", 0), (16, "find", ["."], "a\n", "", 0), (17, "git", ["branch", "-a"], "b", "", 0), (18, "ls", ["-la"], "q\nq", "", 0),
    ]
    df = spark.createDataFrame(data, schema.CAPTURES)
    got = {r.capture_id: r for r in accounting.account(route.compact(df, rules=[{"match_command": "make", "dedupe_lines": True}])).collect()}
    assert {k: r.strategy for k, r in got.items()} == {1: "git.status", 2: "passthrough", 3: "git.mutating", 4: "grep", 5: "passthrough", 6: "grep", 7: "test", 8: "test", 9: "generic", 10: "generic", 11: "cat", 12: "infra", 13: "read", 14: "smart", 15: "passthrough", 16: "find", 17: "passthrough", 18: "ls"}
    assert got[1].output == "?? (1):\n  a" and got[3].output == "ok" and got[4].output == "no matches" and got[7].output == "0 failed, 1 passed"
    assert not got[8].recorded and got[8].output == "" and got[7].recorded
    assert got[9].output == "x\n" and got[10].output == "" and got[11].output == "y  [×2]\n" and got[12].output == "{}"
    assert got[13].output == "x = 1" and got[14].output.startswith("language: python") and got[15].output == "as is"
    assert (got[3].bytes_before, got[3].bytes_after) == (9, 3) and got[10].bytes_after == 4 + len("[exit: 2]\n")
    assert got[2].bytes_after == got[2].bytes_before == 5 and got[6].bytes_after < got[6].bytes_before
    entries = accounting.ledger_rows(accounting.account(route.compact(df)), F.lit(T1))
    assert entries.schema.simpleString() == schema.CALLS.simpleString() and entries.count() == 17
    assert route.compact(df, bypass=["git"]).where("tool = 'git' and strategy <> 'passthrough'").count() == 0


def test_failed_commands_are_shown_and_not_recorded(spark):
    data = [
        (1, "git", ["push"], "out", "err", 1), (2, "git", ["diff"], "out", "err", 128), (3, "grep", ["x"], "out", "err", 2), (4, "find", ["."], "out", "err", 1),
        (5, "read", ["a.py", "--level", "minimal"], "out", "err", 1), (6, "smart", ["a.py"], "out", "err", 1), (7, "smart", ["a.java"], "out", "", 0), (8, "git", ["status", "-s"], "out", "", 1),
    ]
    df = spark.createDataFrame(data, schema.CAPTURES)
    got = {r.capture_id: r for r in route.compact(df).collect()}
    assert {k: r.recorded for k, r in got.items()} == {k: k == 8 for k in range(1, 9)}
    assert {k: r.output for k, r in got.items()} == {1: "", 2: "", 3: "out", 4: "", 5: "", 6: "", 7: "unknown language", 8: "out"}
    assert sum(r.passthrough for r in got.values()) == 1
    assert rows(accounting.ledger_rows(accounting.account(route.compact(df)), F.lit(T1)).select("command_text")) == [("git status -s",)]


def test_modes_of_compaction(spark):
    data = [(1, "git", ["status"], "?? a\n M b\n?? c\n", "", 0), (2, "go", ["test"], "--- FAIL: TestA (0.0s)\n    x\nok\n", "", 1), (3, "go", ["test"], "ok\n", "", 0)]
    got = {r.capture_id: r.output for r in route.compact(spark.createDataFrame(data, schema.CAPTURES), ultra=True, failures_only=True).collect()}
    assert got == {1: got[1], 2: "--- FAIL: TestA (0.0s)\n    x", 3: ""}
    assert "??:2 a c" in got[1] and "M:1 b" in got[1]


def test_first_k_keeps_groups_of_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), (None, 5)], "k string, v int")
    assert rows(lines.first_k(df, ["k"], ["v"], 2).orderBy("v")) == [("a", 1, 1, 2), ("a", 2, 2, 2), (None, 3, 1, 3), (None, 4, 2, 3)]


def test_blank_commands_are_not_rewritten(spark):
    from tallyloom.functions import classify

    df = spark.createDataFrame([(" ",), ("",), (None,), ("ls",)], "c string")
    assert rows(df.select(classify.rewrite(F.col("c")))) == [(None,), (None,), (None,), (classify.PREFIX + "ls",)]


def test_settings_and_retention_of_days(spark, tmp_path):
    from tallyloom.sources import settings

    path = str(tmp_path / "conf" / "settings.json")
    assert settings.load(spark, path) == settings.DEFAULTS == settings.load(spark, path)
    settings.save(spark, {"tee": {"mode": "always"}, "own": 1, "truncate": 7}, path)
    got = settings.load(spark, path)
    assert got["tee"] == settings.DEFAULTS["tee"] | {"mode": "always"} and got["own"] == 1 and got["truncate"] == 7 and got["ignore_files"] == ["*.lock"]
    assert settings.with_tracking(got, False)["tracking"] == {"enabled": False, "history_days": 90} and settings.with_tracking({"tracking": 3}, True)["tracking"] == {"enabled": True}
    (tmp_path / "broken.json").write_text("{")
    assert settings.load(spark, str(tmp_path / "broken.json")) == settings.merged([1]) == settings.DEFAULTS

    ledger_path = str(tmp_path / "days")
    assert sinks.drop_old_days(spark, ledger_path, T1) == []
    sinks.append_calls(calls(spark, [("a", 9, 1, 0, T1 - 91 * 86400), ("b", 9, 1, 0, T1 - 90 * 86400), ("c", 9, 1, 0, T1)]), ledger_path)
    before = sinks.retained(spark.read.parquet(ledger_path), T1).count()
    assert sinks.drop_old_days(spark, ledger_path, T1, 0) == [] and len(sinks.drop_old_days(spark, ledger_path, T1)) == 1
    left = spark.read.parquet(ledger_path)
    assert sinks.retained(left, T1).count() == before == left.count() == 2
    assert rows(ledger.status(schema.migrate(left))) == [(2, T1 - 90 * 86400, T1)]
    sinks.clear(spark, ledger_path)
    assert schema.read_ledger(spark, ledger_path).count() == 0


def test_insights_in_text_and_json(spark):
    import json

    now, old = T1, T1 - 8 * 86400
    some = [("git log x", 9, 1, 0, now, 0), ("git log x", 9, 1, 0, now, 0), ("cat a", 8, 8, 0, now, 1), ("pytest", 5, 9, 3, now, 0), ("old", 9, 1, 2, old, 1), ("", 9, 1, 2, now, 1)]
    df = calls(spark, [("c", before, after, code, at, through, "", command) for command, before, after, code, at, through in some])
    value = json.loads(ledger.insights_json(df, now).first().value)
    assert value == {
        "days": 7,
        "top": 10,
        "repeated": [{"command": "git log x", "calls": 2, "saved_bytes": 16}, {"command": "cat a", "calls": 1, "saved_bytes": 0}, {"command": "pytest", "calls": 1, "saved_bytes": 0}],
        "failing": [{"command": "pytest", "failures": 1, "last_exit": 3}],
        "passthrough": [{"command": "cat a", "calls": 1, "raw_bytes": 8}],
        "suggestions": [ledger.HINT_LOG + "git log x"],
    }
    lines = [r.line for r in ledger.insights_text(df, now).orderBy("pos").collect()]
    assert lines == ["repeated:", "  2 calls  16 bytes saved  git log x", "  1 calls  0 bytes saved  cat a", "  1 calls  0 bytes saved  pytest", "failing:", "  1 failures  last exit 3  pytest", "passthrough:", "  1 calls  8 raw bytes  cat a", "suggestions:", "  " + ledger.HINT_LOG + "git log x"]
    none = [r.line for r in ledger.insights_text(df.limit(0), now).orderBy("pos").collect()]
    assert none == ["repeated:", "  none", "failing:", "  none", "passthrough:", "  none", "suggestions:", "  none"]
    assert json.loads(ledger.insights_json(df.limit(0), now, top=3).first().value)["failing"] == []
    with pytest.raises(ValueError):
        ledger.insights_json(df, now, top=0)
