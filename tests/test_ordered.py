import random
import re
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordered as O


def made(spark, n=400, seed=0, hot=True):
    rng = random.Random(seed)
    lines = [rng.choice(["b", "a", "B", "", None, "10 x", "9 y", " 9", "-3", "é", "\x1b[31mred\x1b[0m", "hot"]) for _ in range(n)]
    if hot:  # a run that is longer than several ranges
        lines[n // 4 : n // 4 * 3] = ["hot"] * (n // 2)
    rows = [(k // 7, k % 7, s, "x") for k, s in enumerate(lines)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "doc bigint, pos int, line string, rest string").repartition(5)


def runs_of(lines):
    return [(k, s, len(list(g))) for k, (s, g) in enumerate(groupby(lines))]


@pytest.fixture
def ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.enabled", before[1])


@pytest.mark.parametrize("seed", [0, 1])
def test_numbers_and_runs_through_many_ranges(spark, ranges, seed):
    rows, df = made(spark, seed=seed)
    lines = O.ranged(df, ["doc", "pos"])
    parts = lines.stored.where("line = 'hot'").select("part").distinct().count()
    assert parts >= 6
    got = sorted((r.line_no, r.doc, r.pos, r.line, r.rest) for r in lines.rows.collect())
    assert got == [(k, *r) for k, r in enumerate(rows)]
    want = runs_of([r[2] for r in rows])
    assert sorted(map(tuple, O.uniq(lines).collect()), key=lambda r: r[0]) == want
    assert sorted(r.pos for r in O.uniq(lines, "repeated").collect()) == [k for k, _, n in want if n > 1]
    assert sorted(r.pos for r in O.uniq(lines, "single").collect()) == [k for k, _, n in want if n == 1]


def test_head_tail_cap_rg_and_wc(spark, ranges):
    rows, df = made(spark, hot=False)
    lines, text, n = O.ranged(df, ["doc", "pos"]), [r[2] for r in rows], len(rows)
    numbers = lambda df: sorted(r.line_no for r in df.collect())
    assert numbers(O.head(lines, 7)) == list(range(7)) and numbers(O.head(lines, -390)) == list(range(10)) and numbers(O.head(lines, 10 * n)) == list(range(n))
    assert numbers(O.tail(lines, 3)) == [n - 3, n - 2, n - 1] and numbers(O.tail(lines, n - 1, start=True)) == [n - 2, n - 1] and numbers(O.tail(lines, 0)) == []
    assert numbers(O.rg(lines, r"^\d+ ")) == [k for k, s in enumerate(text) if re.search(r"^\d+ ", s or "")]
    assert numbers(O.rg(lines, r"^red$", invert=True, colours=True)) == [k for k, s in enumerate(text) if "red" not in (s or "")]
    cut = sorted(map(tuple, O.cap(lines, 9, 2).collect()))
    short = [s if s is None or len(s) <= 2 else s[:2] + "...(truncated)" for s in text]
    assert [c[1] for c in cut] == [*short[:4], O.OMITTED % (n - 9), *short[-5:]] and [c[0] for c in cut] == list(range(10))
    assert O.cap(lines, n).count() == n
    assert O.wc(df).first() == (n, sum(len((s or "").split()) for s in text), sum(len((s or "").encode()) + 1 for s in text))


@pytest.mark.parametrize("options", [{}, {"reverse": True}, {"numeric": True}, {"fold": True}, {"unique": True}, {"numeric": True, "reverse": True, "unique": True}])
def test_sort(spark, ranges, options):
    rows, df = made(spark, seed=3)

    def key(r):
        s = r[2]
        number = int(m[1]) if s is not None and (m := re.match(r"\s*(-?\d+)", s)) else 0
        fold = (s is not None, (s or "").upper().encode())
        return [*([number] if options.get("numeric") else []), *([fold] if options.get("fold") else []), (s is not None, (s or "").encode()), r[:2]]

    want = list({r[2]: r for r in reversed(rows)}.values()) if options.get("unique") else rows
    want = sorted(want, key=key, reverse=options.get("reverse", False))
    lines = O.sort_lines(df, ["doc", "pos"], **options)
    got = sorted((r.line_no, r.doc, r.pos, r.line, r.rest) for r in lines.rows.collect())
    assert got == [(k, *r) for k, r in enumerate(want)]
    counts = Counter(r[2] for r in want)
    assert Counter({r.line: r.n for r in O.uniq(lines).collect()}) == counts and O.uniq(lines).count() == len(counts)


def test_empty_relations_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc bigint, pos int, line string")
    lines = O.ranged(none, ["doc", "pos"])
    assert lines.rows.count() == O.uniq(lines).count() == O.head(lines).count() == O.tail(lines).count() == O.cap(lines).count() == 0
    assert O.wc(none).first() == (0, 0, 0) and O.sort_lines(none, ["doc", "pos"], reverse=True).rows.count() == 0
    with pytest.raises(ValueError):
        O.ranged(none.withColumn("run", F.lit(1)), ["doc", "pos"])


def test_sort_is_dealt_out_though_one_line_is_hot(spark, ranges):
    rows = spark.range(30_000).select(F.col("id").alias("doc"), F.lit(0).alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("line"))
    sizes = [r["count"] for r in O.sort_lines(rows, ["doc", "pos"]).stored.groupBy("part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 3 * 30_000 / 11
