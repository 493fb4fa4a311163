import random
import re

from tallyloom.llm import decontaminate as D


def brute(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: pattern.findall(low(t))
    out = []
    for doc in docs:
        w, hit, names = split(doc), set(), set()
        for name, text in items:
            v = split(text)
            n = min(window, len(v))
            for i in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[i : i + n]:
                        hit |= set(range(p, p + n))
                        if name is not None:
                            names.add(str(name))
        out.append((len(w), len(hit), sorted(names)))
    return out


def cases(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["a", "B", "c", "É", "é", "x-y", "1", "\n", "  ", "D!"]) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(12)] + [(3, some(12)), (None, some(12)), (7, None)]
    docs = [some(rng.randint(0, 60)) for _ in range(30)] + [None, "", "..."]
    docs += [some(3) + " " + t + " " + some(4) for _, t in items if t] + [items[8][1]]
    return docs, items


def test_judge_equals_brute_force():
    for seed in range(12):
        docs, items = cases(seed)
        raw = [(None if i is None else str(i), (t or "").encode()) for i, t in items]
        for blocks in ([D.Block(raw, 10)], [D.Block(raw[:5], 10), D.Block(raw[5:], 10), D.Block([], 10)]):
            sizes, hit, names = D.judge(blocks, [(t or "").encode() for t in docs])
            assert [(a, b, sorted(c)) for a, b, c in zip(sizes, hit, names, strict=True)] == brute(docs, items)


def test_rows_blocks_and_columns(spark):
    docs, items = cases(99)
    df = spark.createDataFrame([(i % 40, t, "w") for i, t in enumerate(docs)], "doc_id bigint, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((i % 40, *x) for i, x in enumerate(brute(docs, items)))
    for size in (8 << 20, 600):
        got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.contamination(df, bench, block_bytes=size).collect())
        assert got == want
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(x[2] == 0 for x in want)
    assert D.contamination(df.limit(0), bench).count() == 0
    assert D.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_matches(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 35)) + " z"), (2, "x")], "doc_id bigint, text string")
    got = D.longest_matches(df, spark.createDataFrame([("i", long)], "item_id string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "i", 2, 5, 30)]


def test_very_long_text(spark):
    words = " ".join(f"v{i}" for i in range(12))
    df = spark.createDataFrame([(1, "q " * 300000 + words)], "doc_id bigint, text string")
    r = D.contamination(df, spark.createDataFrame([(1, words)], "item_id bigint, text string")).first()
    assert (r.n_words, r.n_hit) == (300012, 12)


def test_bitmap_of_windows_misses_none_and_passes_few(spark, tmp_path):
    docs, items = cases(5)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    seen = D.Windows.of(bench, 10, str(tmp_path / "w"))
    n, may = seen.may_hit([(t or "").encode() for t in docs])
    want = brute(docs, items)
    assert n.tolist() == [w[0] for w in want] and all(m for m, w in zip(may, want, strict=True) if w[1])
    rng = random.Random(1)
    others = [" ".join(f"x{rng.randint(0, 10**6)}" for _ in range(300)).encode() for _ in range(300)]
    assert seen.may_hit(others)[1].mean() < 0.02 and seen.may_hit([]) [1].tolist() == []


def test_one_block_and_several(spark):
    """A benchmark of 1 MB in one block of real size and in several smaller ones."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(2_000))) for i in range(80)]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    docs = [(k, f"some text {cut(items[k][1], k, k + 9 + k % 4)} and more {cut(items[-1 - k][1], 105, 117)}") for k in range(60)] + [(99, "clean text of no item " * 20)]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [sorted(map(tuple, D.contamination(df, bench, block_bytes=size).select("doc_id", "n_words", "n_hit", "n_items").collect())) for size in (D.BLOCK_BYTES, 1 << 18)]
    assert got[0] == got[1] and [(d, h, i) for d, _, h, i in got[0]] == [(k, (9 + k % 4 if k % 4 else 0) + 12, 1 + (k % 4 > 0)) for k in range(60)] + [(99, 0, 0)]
    assert [r.doc_id for r in D.decontaminate(df, bench).collect()] == [99]
