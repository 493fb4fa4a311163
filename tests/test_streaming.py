import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ledger
from tallyloom.operators.sessions import spans as batch_spans
from tallyloom.sources import schema, settings, sinks
from tallyloom.streaming import globalsessions as G
from tallyloom.streaming import sessions as S

T1 = 1_700_000_000


def test_sessions_and_days_of_a_stream(spark, tmp_path):
    data = [("h", "c", "git", 10, 4, 0, T1 + t, p, "s") for t, p in ((0, 0), (1000, 1), (100_000, 0), (101_000, 0), (500_000, 0))]
    source = str(tmp_path / "in")
    spark.createDataFrame(data, schema.CALLS).write.parquet(source)
    calls = S.read_calls(spark, source)
    for name, stream in (("sessions", S.session_stream(calls, F.col("category"))), ("days", S.daily_stream(calls))):
        S.write(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination(120)
    got = [(r.calls, r.adoption) for r in spark.read.parquet(str(tmp_path / "sessions")).orderBy("start").collect()]
    assert got == [(2, 50.0), (2, 100.0)]  # the last session is still open
    days = [(r.saved, r.calls) for r in spark.read.parquet(str(tmp_path / "days")).orderBy("day").collect()]
    assert days == [(12, 2), (12, 2)]


def test_registry_and_entry(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).columns == ["strategy", "saved", "calls", "percent"]
    assert sinks.DEFAULT_DAYS == 90


def call_rows(n, seed, span=400_000):
    import random

    rng = random.Random(seed)
    at = sorted(rng.choice([rng.randint(0, span), rng.randint(0, 40) * 1800, rng.randint(0, 8) * 3601]) for _ in range(n))
    return [(f"h{k}", "c", "git", 10, rng.choice([4, 12, None]), 0, T1 + t, rng.choice([0, 1]), "s") for k, t in enumerate(at)]


def test_global_sessions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    import random

    rows, rng = call_rows(300, 1), random.Random(2)
    want = sorted(map(tuple, batch_spans(spark.createDataFrame(rows, schema.CALLS)).collect()))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    late = 150_000
    parts = [[] for _ in range(3)]
    for r in rows:  # every call may come one part late, and parts are in no order
        parts[min(2, (r[6] - T1) // 134_000 + rng.randint(0, 1))].append(r)
    beat = (None,) * 6 + (T1 + 10_000_000, None, None)
    closed = []
    for part in (*parts, [beat]):
        rng.shuffle(part)
        spark.createDataFrame(part, schema.CALLS).repartition(2).write.mode("append").parquet(source)
        spans = G.session_spans(S.read_calls(spark, source), late=f"{late} seconds", width=7200, shares=2)
        S.write(spans, out, state).awaitTermination(300)  # each round restarts from the checkpoint
        closed.append(spark.read.parquet(out).count())
    assert 0 < closed[-2] < closed[-1]
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want
    # what comes after the watermark is in no session
    spark.createDataFrame(rows[:5], schema.CALLS).write.mode("append").parquet(source)
    S.write(G.session_spans(S.read_calls(spark, source), late=f"{late} seconds", width=7200, shares=2), out, state).awaitTermination(300)
    assert spark.read.parquet(out).count() == closed[-1]


def test_islands_merge_in_any_order():
    import random

    for seed in range(50):
        rng = random.Random(seed)
        seconds = [rng.randint(0, 60) for _ in range(rng.randint(0, 20))]
        whole = G.merged([(t, t, 1, t % 2) for t in seconds], 3)
        a = G.merged([(t, t, 1, t % 2) for t in seconds[::2]], 3)
        b = G.merged([(t, t, 1, t % 2) for t in seconds[1::2]], 3)
        assert G.merged(b + a, 3) == whole and sum(i[2] for i in whole) == len(seconds)
        assert all(y[0] - x[1] > 3 for x, y in zip(whole, whole[1:], strict=False))


def test_a_batch_that_is_delivered_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame(call_rows(200, 3), schema.CALLS)
    one, two = rows.where("timestamp % 2 = 0"), rows.where("timestamp % 2 = 1")
    for part, name in ((one, "b-1"), (two, "b-2"), (one, "b-1"), (two, "b-2")):
        assert sinks.append_calls(part, path, name) == name
    assert sorted(map(str, schema.read_ledger(spark, path).collect())) == sorted(map(str, rows.collect()))
    assert ledger.rolled_up(sinks.rollups(spark, path)).first() == (200, 2000, ledger.totals(rows).first().saved)
    # a batch whose roll-ups failed is mended by delivering it again
    sinks.clear(spark, f"{path}/{sinks.ROLLUPS}")
    for part, name in ((one, "b-1"), (two, "b-2")):
        sinks.append_calls(part, path, name)
    assert ledger.rolled_up(sinks.rollups(spark, path)).first().calls == 200
    assert sinks.append_calls(one, path, settings=settings.with_tracking(settings.DEFAULTS, False)) is None
    with pytest.raises(ValueError):
        sinks.append_calls(one, path, "../7")
    assert schema.read_ledger(spark, path).count() == 200
    sinks.append_calls(rows.limit(0), path)
    assert schema.read_ledger(spark, path).count() == 200


def test_stream_into_a_ledger_and_its_restart(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    rows = spark.createDataFrame(call_rows(60, 4), schema.CALLS)
    for k in range(2):
        rows.where(f"timestamp % 2 = {k}").write.mode("append").parquet(source)
        S.append_stream(S.read_calls(spark, source), path, state).awaitTermination(120)
    # the checkpoint loses its last commit, so Spark delivers that batch again
    last = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))[-1]
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    S.append_stream(S.read_calls(spark, source), path, state).awaitTermination(120)
    assert sorted(map(str, schema.read_ledger(spark, path).collect())) == sorted(map(str, rows.collect()))


def test_retention_is_exact_to_the_row(spark, tmp_path):
    path = str(tmp_path / "ledger")
    midnight = T1 // 86400 * 86400
    at = lambda *seconds: spark.createDataFrame([("h", "c", "git", 10, 4, 0, midnight + t, 0, f"s{t % 3}") for t in seconds], schema.CALLS)
    sinks.append_calls(at(-90_000, 100, 5000, 90_000), path, "b-both")
    sinks.append_calls(at(10, 20), path, "b-old")
    sinks.append_calls(at(50_000, 50_001), path, "b-new")
    new_files = lambda: sorted(f for f in spark.read.parquet(path).inputFiles() if "batch=b-new" in f)
    untouched = new_files()
    now = midnight + 5000 + 90 * 86400
    touched = sinks.retain_rows(spark, path, now)
    edge = [t for t in touched if "/" in t]
    assert len(touched) == 3 and [t.split("batch=")[1] for t in edge] == ["b-old", "b-both"]
    left = sinks.ledger_batches(spark, path)
    assert sorted(r.timestamp - midnight for r in left.collect()) == [5000, 50_000, 50_001, 90_000]
    assert new_files() == untouched
    by_rows = left.groupBy("day", "strategy").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes_before").alias("raw"), F.sum(ledger.saved_bytes()).alias("saved"))
    assert sorted(map(tuple, ledger.rolled_up(sinks.rollups(spark, path), "day", "strategy").collect())) == sorted(map(tuple, by_rows.collect()))
    assert sinks.retain_rows(spark, path, now) == [] and sinks.retain_rows(spark, path, now, 0) == [] and sinks.retain_rows(spark, str(tmp_path / "none"), now) == []
    sinks.append_calls(at(1), path, "b-old")  # a batch may come back after it has gone
    assert [t.split("batch=")[1] for t in sinks.retain_rows(spark, path, now)] == ["b-old"]


def test_sessions_without_a_named_shared_folder(tmp_path):
    """In a plain local session nobody names spark.checkpoint.dir; a cluster must."""
    code = "from pyspark.sql import SparkSession\nfrom tallyloom.sources.store import workspace, save, remove\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\na, b = workspace(s, 'x'), workspace(s, 'y')\nassert a != b and save(s.range(3), a).count() == 3\nremove(s, a)\nprint('fine')"
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    assert "fine" in subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, check=True).stdout
