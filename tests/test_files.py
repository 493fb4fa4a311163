import fnmatch
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lines, route
from tallyloom.sources import directory as D
from tallyloom.sources import rawfiles as R


def make_tree(root, seed=0):
    rng = random.Random(seed)
    dirs = [root]
    for k in range(40):
        d = os.path.join(rng.choice(dirs), rng.choice(["a", "b", "node_modules", ".git", "é"]) + rng.choice(["", str(k)]))
        os.makedirs(d, exist_ok=True)
        dirs.append(d)
    for k in range(120):
        with open(os.path.join(rng.choice(dirs[:30]), rng.choice(["f", "x.lock", "y.py", " z"]) + str(k % 9)), "w") as f:
            f.write("x" * k)
    os.symlink(root, os.path.join(root, "loop"))
    os.symlink(os.path.join(root, "gone"), os.path.join(root, "dangling"))
    os.makedirs(os.path.join(root, "empty", "within"), exist_ok=True)


def walked(root, ignored=(), patterns=()):
    out = []
    for place, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if d not in ignored]
        for name, is_dir in [(d, True) for d in dirs] + [(f, False) for f in files if not any(fnmatch.fnmatchcase(f, p) for p in patterns)]:
            path = os.path.join(place, name)
            rel = os.path.relpath(path, root)
            out.append((rel, name, rel.count("/") + 1, is_dir, os.path.islink(path), 0 if is_dir else os.lstat(path).st_size))
    return sorted(out)


@pytest.mark.parametrize("tasks", [1, 5, 64])
def test_entries_equal_a_walk(spark, tmp_path, tasks):
    root = str(tmp_path)
    make_tree(root, tasks)
    for ignored, patterns in (([], []), ([".git", "node_modules"], ["*.lock*", "f[0-3]"])):
        df = D.read_directory(spark, root, ignored, patterns, tasks)
        assert df.columns == ["root", "path", "name", "depth", "is_dir", "is_link", "size"]
        assert sorted(tuple(r)[1:] for r in df.collect()) == walked(root, ignored, patterns)
    one = D.read_directory(spark, root, tasks=tasks).where("depth = 1")
    assert sorted(r.name for r in one.collect()) == sorted(os.listdir(root))
    assert D.read_directory(spark, root, "no list", None).where("depth <= 2 and is_dir").count() == sum(r[3] and r[2] <= 2 for r in walked(root))


def test_what_is_pruned_is_never_opened(tmp_path, monkeypatch):
    make_tree(str(tmp_path), 3)
    opened, scan = [], os.scandir
    monkeypatch.setattr(D.os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or scan(p))

    def read(options, *filters):
        opened.clear()
        reader = D.DirectoryReader({"path": str(tmp_path), "tasks": "3"} | options)
        left = list(reader.pushFilters(list(filters)))
        return [e for share in reader.partitions() for e in reader.read(share)], left

    entries, _ = read({"ignoreDirs": json.dumps([".git", "node_modules"])})
    assert len(entries) == len({e[1] for e in entries}) and not any({".git", "node_modules"} & set(p.split("/")) for p in opened)
    entries, left = read({}, D.LessThanOrEqual(("depth",), 1))
    assert set(opened) == {"."} and left == [] and {e[3] for e in entries} == {1}
    _, left = read({}, D.EqualTo(("depth",), 2), D.EqualTo(("is_dir",), True))
    assert len(left) == 2 and all(p.count("/") < 1 for p in opened)
    with pytest.raises(ValueError):
        D.DirectorySource({"path": __file__}).reader(None)


def test_trees_of_directories_reach_the_router(spark, tmp_path):
    make_tree(str(tmp_path), 5)
    entries = D.read_directory(spark, str(tmp_path), ["node_modules"]).where("not (is_dir and is_link)").withColumn("capture_id", F.lit(7))
    captures = spark.createDataFrame([(7, "tree", ["src/"], "raw", "", 0), (8, "tree", [], "raw", "", 0), (9, "tree", ["a", "b"], "raw", "", 0)], "capture_id int, tool string, args array<string>, stdout string, stderr string, exit_code int")
    got = {r.capture_id: r for r in route.compact(lines.with_trees(captures, entries, F.col("path"), F.col("is_dir"), most=10_000)).collect()}
    want = []
    for place, dirs, files in os.walk(tmp_path):
        dirs[:] = sorted(d for d in dirs if d != "node_modules")
        rel = os.path.relpath(place, tmp_path)
        depth = 0 if rel == "." else rel.count("/") + 1
        want += ["  " * depth + f"{'src' if rel == '.' else os.path.basename(place)} ({len(files)})"] + ["  " * depth + f"  {name}" for name in sorted(files)]
    assert got[7].output.split("\n") == want and (got[7].strategy, got[7].recorded, got[7].passthrough) == ("tree", False, 0)
    assert (got[8].output, got[8].passthrough, got[9].output, got[9].passthrough) == ("raw", 1, "raw", 1)


def shown(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith("."))


def test_raw_files_are_whole_or_not_there(spark, tmp_path):
    folder = str(tmp_path / "raw")
    rows = spark.range(250).select(F.format_string("%d_%08x.log", F.col("id") + 1000, "id").alias("name"), F.concat(F.lit("é"), F.col("id")).alias("value")).repartition(7)
    R.write_raw(rows, folder, keep=300)
    assert len(shown(folder)) == len(os.listdir(folder)) == 250
    assert open(os.path.join(folder, "1007_00000007.log"), encoding="utf-8").read() == "é7" and os.stat(os.path.join(folder, "1007_00000007.log")).st_mode & 0o777 == 0o600
    # a job that fails leaves nothing new, and nothing hidden
    broken = rows.select(F.concat(F.lit("9_"), "name").alias("name"), "value").unionByName(spark.createDataFrame([("../up", "x")], "name string, value string"))
    with pytest.raises(Exception, match="not a file name"):
        broken.write.format("rawfiles").mode("append").save(folder)
    assert len(os.listdir(folder)) == 250 and not os.path.exists(tmp_path / "up")
    assert len(R.retain_raw(folder)) == 150 and shown(folder)[0].startswith("1150_") and R.retain_raw(folder) == []
    R.write_raw(rows.limit(0), folder)
    assert len(os.listdir(folder)) == 100 and R.retain_raw(str(tmp_path / "none")) == []


def test_killed_and_lost_attempts_leave_nothing(tmp_path):
    from pyspark.sql import Row

    folder = str(tmp_path)
    writer, other = R.RawWriter(folder), R.RawWriter(folder)
    row = lambda n, v: Row(name=n, value=v)
    won = writer.write(iter([row("1_a.log", "x"), row("2_b.log", None)]))
    writer.write(iter([row("1_a.log", "half")]))  # an attempt whose message never came

    def dies():
        yield row("3_c.log", "y")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(dies())
    kept = other.write(iter([row("4_d.log", "z")]))
    assert shown(folder) == []
    writer.commit([won, None])
    assert shown(folder) == ["1_a.log", "2_b.log"] and (tmp_path / "1_a.log").read_text() == "x" and (tmp_path / "2_b.log").read_text() == ""
    assert len(os.listdir(folder)) == 4  # what another job has written is its own
    other.commit([kept])
    assert shown(folder) == sorted(os.listdir(folder)) == ["1_a.log", "2_b.log", "4_d.log"]
    last = R.RawWriter(folder)
    last.abort([last.write(iter([row("5_e.log", "z")]))])
    assert len(os.listdir(folder)) == 3
