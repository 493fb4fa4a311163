import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tallyloom.llm import filteraudit as A
from tallyloom.llm.common import workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mask(text):
    w = WORD.findall(text)
    return (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))


def masks_brute(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    return Counter((i, s or "", mask(t or "") + 16 * (i is not None and i > least[t or ""])) for i, t, s in rows)


def audit_brute(masks, labels):
    """Each order is applied document by document."""
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in masks}:
        docs = [(i, m) for (i, p, m), n in masks.items() if p == part for _ in range(n)]
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                went, stay = [d for d in left if d[1] & bit], [d for d in left if not d[1] & bit]
                failing = sum(bool(m & bit) for _, m in docs)
                shapley[part, letter] += len(went)
                out[part, "".join(order), step] = (len(stay), len(went), failing - len(went), sum(m == bit for _, m in docs), sum(i in good for i, _ in went), sum(i in bad for i, _ in went))
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def some_rows(seed, n=160):
    rng = random.Random(seed)
    texts = [None, "", " \t", "é" * 64, "é" * 63 + "e", "x" * 600, "x" * 599 + "y", "Aa bB # c", "word " * 250, " ".join(f"w{i}" for i in range(230)), "UP " * 3 + "low " * 300, "a\x0bb\x1cc", "z" * 40_000 + "1", "z" * 40_000 + "2"]
    return [(rng.choice([None, *range(90)]) if rng.random() < 0.1 else rng.randint(0, 90), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(n)]


def test_masks_and_counts_equal_brute_force(spark):
    for seed in range(2):
        rows = some_rows(seed)
        df = spark.createDataFrame([(i, t, s, 5, "m") for i, t, s in rows], "doc_id bigint, text string, source string, mask int, part string")
        got = A.filter_masks(df, workspace(spark, "audit"))
        want = masks_brute(rows)
        assert Counter((r.id, r.part, r["mask"]) for r in got.collect()) == want
        rng = random.Random(seed)
        labels = [(rng.randint(0, 90), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1), (1, 1, 0), (1, 0, 1)]
        counts = A.audit(got, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in A.COUNTS) for r in counts} == audit_brute(want, labels)
        assert len(counts) == 3 * 600


def test_equal_hashes_are_told_apart_by_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(A, "block_hashes", lambda text: F.array(F.lit(1).cast("bigint")))
    monkeypatch.setattr(A, "chained", lambda start, hashes: F.lit(7).cast("bigint"))
    monkeypatch.setattr(A, "refined", lambda rows, root: rows.groupBy("chain").agg(F.min("id").alias("first")))
    rows = some_rows(7, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = A.filter_masks(df, workspace(spark, "audit")).collect()
    assert Counter((r.id, r.part, r["mask"]) for r in got) == masks_brute(rows)


def test_blocks_cover_texts_of_any_length(spark):
    texts = ["", "é", "a" * 64, "a" * 65, "a" * 512, "a" * 513, "é" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(F.size(A.block_hashes(F.col("text")))).collect()] == [1, 1, 1, 2, 2, 3, 4]
    base = "q" * 5000
    seen = spark.createDataFrame([(base[:k] + "r" + base[k + 1 :],) for k in (0, 63, 64, 511, 512, 4095, 4096, 4999)], "text string").select(A.block_hashes(F.col("text")).alias("h")).collect()
    first = spark.createDataFrame([(base,)], "text string").select(A.block_hashes(F.col("text")).alias("h")).first().h
    assert [[a != b for a, b in zip(r.h, first, strict=True)].index(True) for r in seen] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert A.audit(A.filter_masks(docs, workspace(spark, "audit")), labels).count() == 0
