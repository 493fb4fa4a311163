import base64
import gzip
import hashlib
import random
from collections import Counter

from tallyloom.llm import exactdedup as X
from tallyloom.llm import linededup as L
from tallyloom.llm import warc as W
from tallyloom.llm.common import workspace
from tallyloom.llm.runs import SortedRuns, filter_of, may_hold

BLANKS = " \t\n\x0b\x0c\r"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def lines_brute(rows, least=20, docs=3):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(BLANKS))
    holders = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            holders.setdefault(key(s), set()).add(i)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [s for s in all_ if len(key(s)) < least or len(holders[key(s)]) < docs or max(holders[key(s)], key=rank) == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["The same licence line in many documents", " the same licence line in many documents\t", "ÉCOLE une ligne assez longue", "école une ligne assez longue", "short", "", "   ", "line number twenty-one or so %d"]
    rows = [(i % 50, "\n".join(rng.choice(pool).replace("%d", str(rng.randint(0, 30))) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(None, "The same licence line in many documents\nx"), (7, None), (8, ""), (9, "The same licence line in many documents\n" * 3000)]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id bigint, text string, pos int, rest string")
    got = L.dedup_lines(df, batches=3)
    assert got.columns == ["doc_id", "text", "pos", "rest", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == Counter(lines_brute(rows))
    assert L.dedup_lines(df.limit(0)).count() == 0


def exact_brute(rows):
    groups = {}
    norm = lambda t: (t or "").translate({ord(c): None for c in BLANKS})
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        best = min(groups[norm(t)])
        out.append((i, best[3], len(groups[norm(t)]), (-len(t or ""), i) == (best[0], best[3]), sha(norm(t))))
    return out


def test_exact_dedup_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a b", "ab", " a\tb", "a\xa0b", "c", "", None, "x" * 300000])) for i in range(60)] + [(None, "ab"), (None, "only"), (3, "c"), (3, "c")]
    df = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id bigint, text string, digest string")
    want = Counter(exact_brute(rows))
    assert Counter(map(tuple, X.exact_dedup(df).collect())) == want
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_survives_a_digest_collision(spark, monkeypatch):
    rows = [(1, "aa"), (2, "ab"), (3, "a b"), (4, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    real = X.F.sha2
    monkeypatch.setattr(X.F, "sha2", lambda c, n: real(X.F.substring(c, 1, 1), n))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(df).collect()}
    assert got == {1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


def test_runs_compact_and_anti_join(spark):
    F = X.F
    runs = SortedRuns(spark, workspace(spark, "t"), "k", lambda: [F.sum("n").alias("n")], fanout=2)
    for b in range(5):
        batch = spark.createDataFrame([(f"k{b}", 1), ("all", 1)], "k string, n bigint")
        assert {r.k: r.fresh for r in runs.split(batch).collect()} == {f"k{b}": True, "all": not b}
        runs.add(batch)
    assert [spark.read.parquet(p).count() for p in runs.known] == [0, 1, 1, 1, 1]
    assert sum(spark.read.parquet(*paths).count() for paths in runs.levels if paths) == 6
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.k: r.n for r in runs.entries().collect()} == {"all": 5} | {f"k{b}": 1 for b in range(5)}


def test_filters_never_miss(spark):
    F = X.F
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    others = spark.range(3000, 6000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    for bits in (15, 18, 20):
        pages = filter_of(keys, "k", bits)
        assert may_hold(keys, pages, "k", bits).where("maybe").count() == 3000
        assert may_hold(others, pages, "k", bits).where("maybe").count() <= 3000 * 3000 / 2**bits * 1.5 + 20
    assert may_hold(keys, filter_of(keys.limit(0), "k", 15), "k", 15).where("maybe").count() == 0


def warc_brute(rows, least=0):
    groups = {}
    for i, h in rows:
        groups.setdefault(h or "", []).append((i is not None, i or 0))
    out = []
    for i, h in rows:
        p = (h or "").encode()
        first = max(groups[h or ""])
        same = len(p) < least or first == (i is not None, i or 0)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if same else "revisit", None if same else first[1]))
    return out


def test_warc_round_trip(spark):
    rng = random.Random(7)
    htmls = ["<p>é</p>", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz", "", None, "\n", "big " * 100000, "\r\n\r\n"]
    rows = [(i, rng.choice([*htmls, f"own {i}"])) for i in range(70)] + [(None, "a"), (None, "\n"), (5, "twice"), (5, "twice")]
    pages = spark.createDataFrame([(i, rng.choice(["http://a/ b\r\nX: y", None, "http://c"]), h, "z") for i, h in rows], "page_id bigint, url string, html string, digest string")
    for least in (0, 3):
        path = workspace(spark, "warc-test") + "/w"
        W.write_warc(pages, path, min_bytes=least)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.resolved(W.read_warc(spark, path)).collect()]
        assert Counter(got) == Counter(warc_brute(rows, least))
    path = workspace(spark, "warc-test") + "/w"
    W.write_warc(pages.limit(0), path)
    assert W.resolved(W.read_warc(spark, path)).count() == 0


def test_warc_parts_are_bounded(spark):
    rows = [(i, "h" * (10 if i % 3 else 5000) + str(i % 40)) for i in range(120)] + [(500 + i, "L" * 70000 + str(i % 2)) for i in range(4)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id bigint, url string, html string").coalesce(1)
    path = workspace(spark, "warc-test") + "/w"
    W.write_warc(pages, path, classes=((100, 50), (6000, 2)))
    parts = [list(W.parse_warc(bytes(r.content))) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    held = [[len(block) for head, block in part if head["warc-type"] == "response"] for part in parts]
    assert all(len(p) <= 50 for p in parts) and all(len(x) <= 2 for x in held if x and max(x) > 1000) and all(len(x) == 1 for x in held if x and max(x) > 60000)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.resolved(W.read_warc(spark, path)).collect()]
    assert Counter(got) == Counter(warc_brute(rows))


def test_warc_parser_refuses_damage():
    import pytest

    with pytest.raises(ValueError):
        list(W.parse_warc(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(W.parse_warc(b"hello\r\n"))
