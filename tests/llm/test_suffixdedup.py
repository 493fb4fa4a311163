import hashlib
import random
from collections import Counter

import numpy as np

from tallyloom.llm import suffixdedup as S
from tallyloom.llm.rolling import stretch_hashes


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def make(seed, window):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [some(rng.randint(window // 2, window * 3)) for _ in range(5)] + ["ab" * window, "x" * (window * 2)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else some(rng.randint(0, window)) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(70, rows[3][1]), (71, rows[3][1] + "tail"), (72, None), (None, rows[5][1]), (3, rows[3][1]), (73, shared[0][: window - 1]), (74, "\0" * (window + 3) + some(9)), (75, "\0" * (window + 1))]
    return rows


def test_cover_and_hashes():
    for a in range(S.COVER_PERIOD):
        for b in range(S.COVER_PERIOD):
            assert any((a + d) % S.COVER_PERIOD in S.COVER and (b + d) % S.COVER_PERIOD in S.COVER for d in range(S.COVER_PERIOD))
    data = np.frombuffer(random.Random(1).randbytes(3000) * 2, np.uint8)
    h = stretch_hashes(data, 50)
    assert (h[:2951] == h[3000:5951]).all() and len(np.unique(h[:2951])) == 2951


def test_sorted_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        base = ["".join(rng.choice("ab\0") for _ in range(300)) for _ in range(3)] + ["a" * 300, "ab" * 150]
        parts = []
        for _ in range(rng.randint(1, 12)):
            t = rng.choice(base)
            a = rng.randint(0, 60)
            parts.append((t[a : a + rng.randint(100, 200)] + rng.choice(["", "b", "q"])).encode())
        seen = Counter(p[i : i + 100] for p in parts for i in range(len(p) - 99))
        for p, mask in zip(parts, S.repeated_starts(parts, 100), strict=True):
            assert mask.tolist() == [seen[p[i : i + 100]] > 1 for i in range(len(p) - 99)]


def test_rows_equal_brute_force(spark):
    for seed, window, context in ((1, 200, 50), (2, 60, 20)):
        rows = make(seed, window)
        df = spark.createDataFrame([(i, t, b"k") for i, t in rows], "doc_id bigint, text string, digest binary")
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, window=window, context=context).collect())
        assert got == Counter(brute(rows, window))
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_pieces_of_long_texts_cover_each_start_once(monkeypatch):
    texts = [random.Random(1).randbytes(n) for n in (3000, 10, 199, 200, 701, 0, 1500)]
    whole = {(t, s + k): (spot, key) for t, s, n, spot, key in zip(*(np.concatenate(c).tolist() for c in zip(*S.segments(texts, 200, 50), strict=True)), strict=True) for k in range(n)}
    monkeypatch.setattr(S, "STRETCH", 500)
    rows = [(t, s + k, spot, key) for t, s, n, spot, key in zip(*(np.concatenate(c).tolist() for c in zip(*S.segments(texts, 200, 50), strict=True)), strict=True) for k in range(n)]
    assert len(rows) == len(whole) == sum(max(0, len(t) - 199) for t in texts)
    assert {(t, s): (spot, key) for t, s, spot, key in rows} == whole


def test_hot_minimizers(spark):
    rows = make(3, 60)
    rng = random.Random(4)
    edge = "".join(rng.choice("pqrstuv") for _ in range(70))
    rows += [(100 + i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + edge + "".join(rng.choice("xyz") for _ in range(50))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter(brute(rows, 60))
    for hot_bytes in (0, 2000, S.HOT_BYTES):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, window=60, context=20, hot_bytes=hot_bytes).collect())
        assert got == want, hot_bytes


def test_full_filters_change_no_row_and_no_bucket(spark, monkeypatch):
    rows = make(3, 60)
    rng = random.Random(4)
    edge = "".join(rng.choice("pqrstuv") for _ in range(70))
    rows += [(100 + i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + edge + "".join(rng.choice("xyz") for _ in range(50))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, of = Counter(brute(rows, 60)), S.Bitmap.of
    full = lambda b: type(b)(b.bits, np.full_like(b.packed, 0xFF))
    for name in ("low", "key"):  # the filter of copies to send; those of shared and of hot minimizers
        monkeypatch.setattr(S.Bitmap, "of", staticmethod(lambda values, name=name: full(of(values)) if values.columns[0] == name else of(values)))
        for hot_bytes in (2000, S.HOT_BYTES):
            got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, window=60, context=20, hot_bytes=hot_bytes).collect())
            assert got == want, (name, hot_bytes)


def test_buckets_hold_distinct_text_however_many_copies_come():
    import tracemalloc

    import pyarrow as pa

    part = lambda k: random.Random(k).randbytes(3000)
    sent = [(b, s) for b in range(3) for s in [b * 10 + k % 4 for k in range(8_000)]]
    batches = (pa.record_batch([pa.array([b for b, _ in sent[i : i + 500]], pa.int64()), pa.array([b"%d" % s for _, s in sent[i : i + 500]]), pa.array([part(s) for _, s in sent[i : i + 500]])], ["bucket", "segment", "part"]) for i in range(0, len(sent), 500))
    tracemalloc.start()
    got = list(S.distinct_parts(batches))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got == [{b"%d" % s: part(s) for s in range(b * 10, b * 10 + 4)} for b in range(3)]
    assert peak < 12 << 20, peak  # 72 MB came by


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    text = random.Random(7).randbytes(16 << 20)
    tracemalloc.start()
    n = sum(int(size.sum()) for _, _, size, _, _ in S.segments([text], 200, 50))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == len(text) - 199 and peak < 100 << 20, peak


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((i, n, k, s, hashlib.sha256(t).hexdigest()) for i, n, k, s, t in brute(rows, 200))
    assert Counter(map(tuple, S.op10_suffix_dedup(spark, sf).collect())) == want
