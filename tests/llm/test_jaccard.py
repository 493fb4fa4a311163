import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from tallyloom.llm import jaccard as J
from tallyloom.llm.common import workspace
from tallyloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([(r[0], s) for r, s in zip(rows, sets, strict=True) if r[0] is not None and s], 2):
        n = len(a & b)
        if 100 * n >= percent * (len(a) + len(b) - n):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return Counter((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True))


def copies(rng, n):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "BETA", "\tgamma", f"n{rng.randint(0, 99)}"])
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 3000)}"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 30, 60, 200])))
        rows.append((i, t))
    return rows


def counting(sets, percent, often):
    """The signatures of each set that count, the rarest first."""
    sigs, number, band, need = J.signatures(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets]), percent)
    out = []
    for k in range(len(sets)):
        own = set()
        for x in np.unique(band[number == k]):
            here = (number == k) & (band == x)
            ranked = sorted(sigs[here].tolist(), key=lambda v: (often(v), v))
            own.update((x, v) for v in ranked[: int(need[here][0])])
        out.append(own)
    return out


def test_similar_sets_share_a_signature_that_counts():
    rng = np.random.default_rng(4)
    tried = 0
    for percent in (80, 85, 95):
        for _ in range(2000):
            n = int(rng.choice([1, 2, 3, 5, 7, 9, 12, 16, 20, 27, 40, 80, 150, 500]))
            base = rng.integers(0, 1 << 63, n * 2, dtype=np.uint64)
            a = base[:n]
            keep = a[rng.random(n) < rng.uniform(percent / 100 - 0.05, 1)]
            b = np.unique(np.concatenate([keep, base[n : n + int(rng.integers(0, max(1, n // 8) + 1))]]))
            a = np.unique(a)
            if J.similar(a, b, percent):
                tried += 1
                of_a, of_b = counting([a, b], percent, lambda v: v % 3)
                assert of_a & of_b, (n, percent)
    assert tried > 1000


def test_any_set_has_complete_signatures():
    rng = np.random.default_rng(9)
    for percent in (80, 85):
        for low, _, _ in J.bands(200_000, percent)[3::4]:  # the low end of a band holds the emptiest partitions
            parts = np.lcm.reduce(np.array([n for lo, hi, n in J.bands(low, percent) if lo <= low <= hi], np.uint64))
            differ = low * (100 - percent) // (100 + percent)
            for scale in (np.uint64(1), parts):  # any elements; all in one partition, so that all equal partitions are empty
                drawn = np.unique(rng.integers(0, (1 << 63) // int(scale), low + differ + 9, dtype=np.uint64))
                drawn = rng.permutation(drawn)[: low + differ] * scale
                a, b = np.sort(drawn[:low]), np.sort(drawn[differ:])
                assert J.similar(a, b, percent)
                of_a, of_b = counting([a, b], percent, lambda v: v % 5)
                assert of_a & of_b, (low, percent)


def test_many_large_sets_are_never_refused():
    rng = np.random.default_rng(2)
    for low, _, n in J.bands(100_000, 85)[-3:]:
        for _ in range(5):
            elements = np.unique(rng.integers(0, 1 << 63, low, dtype=np.uint64))
            sigs, _, _, _ = J.signatures(elements, np.array([0, len(elements)]), 85)
            assert 0 < len(sigs) <= 4 * n


def test_shingles_equal_python():
    texts = [b"", b"  ", b"one", b"One two", "Éa b\xa0c d e f".encode(), b"a b c d a b c d", b"x " * 5000, (b"w" * 600_000 + b" ") * 5, b"\x0bA\tB\nC D"]
    elements, bounds = J.shingle_sets(texts, 4)
    seen: dict = {}
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        w = t.lower().split()
        k = min(4, len(w))
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        own = elements[a:b]
        assert len(own) == len(want) and (own[1:] > own[:-1]).all()
        assert seen.setdefault(tuple(own.tolist()), want) == want
    alone, _ = J.shingle_sets([b"C d x y"], 4)
    again, _ = J.shingle_sets([b"q q", b"c D X Y"], 4)
    assert alone[0] == again[-1]


def test_pairs_within_blocks():
    rng = np.random.default_rng(5)
    for size in (3, 60, 700):
        base = np.sort(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        sets = [np.unique(np.concatenate([base[:1], base[rng.random(size) < 0.95], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + size // 7)), dtype=np.uint64)])) for _ in range(40)]
        everyone, far, n = np.ones(40, bool), np.full(40, 10_000), np.array([len(x) for x in sets])
        want = {(r, s) for r in range(40) for s in range(40) if r != s and J.similar(sets[r], sets[s], 85)}
        found = set(J.pairs_within([J.parity(x) for x in sets], n, far, np.arange(40), everyone, everyone, 85))
        assert want <= found and want and len(found) <= max(1.5 * len(want), 40 * 39 if size == 3 else 0)
        assert not J.pairs_within([J.parity(x) for x in sets], n, far, np.zeros(40), everyone, everyone, 85)


def test_groups_equal_brute_force(spark):
    for seed, size, percent in ((1, 4, 85), (2, 5, 80)):
        rows = copies(random.Random(seed), 260)
        rows += [(None, rows[0][1]), (None, None), (300, None), (301, ""), (302, "  \n"), (303, "One two"), (304, "one TWO"), (305, "éa"), (306, "Éa"), (307, "a\xa0b"), (308, "a b")]
        df = spark.createDataFrame([(i, t, 1, "d") for i, t in rows], "doc_id bigint, text string, n int, digest string")
        assert Counter(map(tuple, J.similar_groups(df, size, percent).collect())) == brute(rows, size, percent)
        kept = J.keep_one_of_each(df, size, percent)
        assert kept.columns == df.columns
        heads = {i for i, _, c in brute(rows, size, percent) if i is not None and i == c}
        assert Counter(r.doc_id for r in kept.collect()) == Counter([*heads, None, None])


def test_blocks_of_any_size_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):  # one large group of near copies, of which some are linked and some aren't
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 4, 85)
    for block in (J.BLOCK, 400):
        monkeypatch.setattr(J, "BLOCK", block)
        assert Counter(map(tuple, J.similar_groups(df, 4, 85).collect())) == want


def test_repeated_ids_and_empty(spark):
    rows = [(1, "a b c d e"), (2, "v w x y z"), (2, "a b c d e"), (3, "v w x y z"), (3, "v w x y z"), (4, "q " * 200000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.component_id) for r in J.similar_groups(df, 4, 85).collect())
    assert got == Counter([(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 4)])
    assert J.similar_groups(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(900, k) for k in range(901, 990)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = dict(map(tuple, components(df, workspace(spark, "cc")).collect()))
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_workers_make_sets_of_few_texts_at_a_time():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    batch = pa.record_batch({"text": pa.array([" ".join(rng.choices(words, k=450)).encode() for _ in range(1600)])})
    peaks = {}
    for texts in (400, 1600):
        tracemalloc.start()
        rows = n = 0
        for part, elements, bounds, digests in J._sets(iter([batch.slice(0, texts)]), 0, 5):
            rows, n = rows + part.num_rows, n + len(elements)
            assert len(J.signatures(elements, bounds, 80)[0]) and len(digests) == part.num_rows
        peaks[texts] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == texts and n == 446 * texts
    assert batch.nbytes > 3.5e6 and peaks[1600] < 16e6 and peaks[1600] < 1.2 * peaks[400]
