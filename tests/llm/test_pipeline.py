import hashlib
from collections import Counter

import sentencepiece

import corpus_pipeline as C
from tallyloom.llm import piececode as P
from tallyloom.llm import quality as Q
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_dedup import lines_brute
from tests.llm.test_jaccard import brute as groups

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    """Each stage on the rows that the one before kept, the classifier's decisions being its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in Q.score(docs, Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("selected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    rows = [(i, t) for i, _, _, t in lines_brute(rows)]
    heads = {i for i, _, c in groups(rows, 5, 80) if i == c}
    rows = [(i, t) for i, t in rows if i in heads]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, (_, hit, _) in zip(rows, windows([t for _, t in rows], items), strict=True) if not hit]
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    want = {i: (library.encode(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    got = {r.doc_id: (r.token_ids, r.text_sha256) for r in C.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, "ok text " * 9, "en", "s", 5, "x"), (1, "ok text " * 9, "en", "s", 5, "x"), (2, None, None, None, None, None), (None, "", "en", "s", 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string")
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        again = stage(spark, docs.limit(0), SF)
        assert again.count() == 0
        if k < len(C.STAGES) - 1:
            assert Counter(out.columns) == Counter(docs.columns)
        out.collect()
