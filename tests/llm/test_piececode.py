import hashlib
import random

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as C
from tallyloom.llm import piececode as P


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def texts():
    rng = random.Random(11)
    docs = [t for t in open(__file__, encoding="utf-8").read().split("\n\n")]
    alphabets = ["ab ", "the and ing of  ", "éèà ñ ", "漢字仮名交じり文", "aaaa", "     x", "\n\t ab", "🙂🙃 \U0001f469‍", "0123456789", "▁ a▁"]
    for a in alphabets:
        docs += ["".join(rng.choice(a) for _ in range(rng.randint(1, 120))) for _ in range(12)]
    docs += ["".join(rng.choice(["the", "ing", "tion", "tokenization", "한국어", "ß", " ", "  ", "\n", "日本", "x" * 9]) for _ in range(40)) for _ in range(40)]
    return docs + [" ", "", "  ", "a", "▁", "\0", " lead", "trail "]


def test_scan_equals_library(library):
    model = P.pieces(P.MODEL)
    for t in texts():
        want = library.encode(t)
        assert np.frombuffer(model.encode_plain(P.MARK + t.replace(" ", P.MARK)) if t else b"", "<i4").tolist() == want, t
        for size in (1, 3, 7, 20, 64):
            if t:
                assert np.frombuffer(P.encode_giant(model, t, size), "<i4").tolist() == want, (size, t)
        assert model.decode(np.array(want, int)).decode("utf-8", "replace") == library.decode(want)


def test_combine_is_associative():
    model = P.pieces(P.MODEL)
    for t in texts()[::7]:
        parts = [P.Chunk(model, *seen).transfer() for seen in P.cut(P.MARK + t.replace(" ", P.MARK), 5, model.longest)]
        for a, b, c in zip(parts, parts[1:], parts[2:], strict=False):
            assert P.combine(P.combine(a, b), c) == P.combine(a, P.combine(b, c))


def test_rows(spark, library):
    long = "".join(random.Random(2).choice(["word ", "tion", " ", "漢", "\n", "the "]) for _ in range(9000))
    rows = [(1, "hello world"), (1, "hello world"), (1, long), (1, long), (2, None), (3, ""), (None, "x y"), (4, "無" * 3000), (5, "a " * 100000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, key string")
    encoded = P.encode(df, chunk_chars=700, fan=4)
    got = P.decode(encoded).collect()
    want = [(i, library.encode(t or ""), t or "") for i, t in rows]
    order = lambda x: (str(x[0]), len(x[1]), x[2])
    assert sorted(((r.doc_id, r.token_ids, r.text) for r in got), key=order) == sorted(want, key=order)
    assert P.encode(df.limit(0)).count() == 0


def python_steps(node):
    """The most Python steps on a way from the plan's root to a leaf."""
    below = node.children()
    return ("MapInArrow" in node.nodeName()) + max((python_steps(below.apply(k)) for k in range(below.size())), default=0)


def test_encoding_and_decoding_take_one_worker_a_task(spark, library):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x  y"), (4, "無 " * 3000), (4, "é" * 700), (5, "a " * 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = P.encode(df, chunk_chars=700, fan=4, decoded=True)
    assert out.columns == ["doc_id", "token_ids", "text"]
    want = [(i, library.encode(t or ""), t or "") for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.token_ids, r.text)) for r in out.collect())
    assert P.encode(df.limit(0), decoded=True).count() == 0
    stage = C.piece_stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001")
    for frame in (out, stage, P.op1_sentencepiece(spark, "/root/testdata/sf0.001")):
        assert python_steps(frame._jdf.queryExecution().sparkPlan()) == 1


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.op1_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id])
        assert (r.token_ids, r.n_tokens, r.text_sha256) == (want, len(want), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
