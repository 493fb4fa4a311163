import math
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import quality as Q
from tallyloom.llm import toxicity as T
from tallyloom.llm.hashedtext import Sparse

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_toxicity_on_held_out_rows(spark):
    got = T.op7_toxicity(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    assert auc(held.score.values, held.toxic.values) > 0.9
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert hit.sum() / (held.toxic == 1).sum() > 0.8 and hit.sum() / (held.predicted == 1).sum() > 0.75


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 0.1), (1, "you idiot", 0.1), (2, None, 0.2), (None, "", 0.3), (4, "fine " * 50000, 0.4)], "doc_id bigint, text string, score double")
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = T.score(docs, T.fit(docs, empty)).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 1), (1, None), (2, 0), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    assert T.score(docs, T.fit(docs, some)).count() == 5
    assert T.score(docs.limit(0), T.fit(docs.limit(0), some)).count() == 0


def test_risk_is_not_pushed_below_zero():
    rng = np.random.default_rng(0)
    rows = lambda n, p: [(np.array([5 if rng.random() < p else 9, int(rng.integers(100, 5000))], np.int32), np.ones(2)) for _ in range(n)]
    positive, unlabelled = Sparse(rows(200, 0.95)), Sparse(rows(800, 0.2))
    w, b = T.train(positive, unlabelled, 0.2)
    assert w[5] > w[9]


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = T.held_out(labels.doc_id)
    model = Q.fit(docs, labels.where(~held))
    got = Q.score(docs, model).toPandas().merge(labels.where(held).toPandas(), on="doc_id")
    assert auc(got.tail_probability.values, got.quality.values) > 0.99
    assert got[got.quality == 1].selected.mean() > 0.99 and got[got.quality == 0].selected.mean() < 0.15


def test_ordinal_thresholds_and_gradient():
    rng = np.random.default_rng(1)
    truth = np.zeros(Q.SIZE)
    truth[:40] = rng.normal(0, 1.5, 40)
    rows = [(np.sort(rng.choice(40, 6, False)).astype(np.int32), np.ones(6)) for _ in range(3000)]
    x = Sparse(rows)
    cuts = np.array([-3.0, -1.0, 1.0, 3.0])
    grade = (x.score(truth)[:, None] + rng.logistic(size=(3000, 1)) > cuts).sum(1)
    w, t = Q.train(x, grade, 5)
    assert (np.diff(t) > 0).all()
    place = x.score(w)
    assert np.corrcoef(place, x.score(truth))[0, 1] > 0.95
    model = Q.Ordinal(w, t, [1, 2, 3, 4, 5])
    tail = 1 / (1 + np.exp(-(place[:, None] - model.thresholds)))
    for j in range(4):
        assert abs(tail[:, j].mean() - (grade > j).mean()) < 0.03


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (1, "good text here", 1), (2, None, 2), (None, "", 3), (4, "x$$$ " * 40000, 4)], "doc_id bigint, text string, selected int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = Q.fit(docs, none)
    assert {(r.expected_grade, r.selected) for r in Q.score(docs, model).collect()} == {(0.0, False)}
    one = Q.fit(docs, spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, quality int"))
    assert {(r.expected_grade, r.tail_probability) for r in Q.score(docs, one).collect()} == {(1.0, 1.0)}
    model = Q.fit(docs, spark.createDataFrame([(1, 3), (4, 1), (4, 2), (2, 2)], "doc_id bigint, quality int"))
    assert model.grades == [1, 2, 3]
    got = Q.score(docs, model, min_grade=2).collect()
    assert len(got) == 5 and all(1 <= r.expected_grade <= 3 for r in got)
    kept = Q.select_good(docs, model, min_grade=1)
    assert kept.columns == docs.columns and kept.count() == 5
    assert Q.score(docs.limit(0), model).count() == 0
    with pytest.raises(Exception):
        Q.fit(docs, none, grade_col="missing")


def test_toxicity_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, bias = T.fit(docs, labels)
    weights = weights.astype("f4")
    got = {r.doc_id: r for r in T.op7_toxicity(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        distinct = {w for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode().lower())}
        z = sum(float(weights[T.slot(w)]) for w in distinct) + bias
        score = 1 / (1 + math.exp(-z))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels)
    weights = model.weights.astype("f4")
    got = {r.doc_id: r for r in Q.op4_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        words = (r.text or "").encode().split()
        place = Q.MARK * sum(float(weights[Q.slot(f)]) for f in Q.text_marks(words))
        for w in words:
            place += Q.SHARE * sum(float(weights[Q.slot(f)]) for f in Q.word_features(w)) / len(words)
        tails = [1.0, *(1 / (1 + math.exp(t - place)) for t in model.thresholds), 0.0]
        expected = sum(g * (a - b) for g, a, b in zip(model.grades, tails, tails[1:], strict=False))
        assert abs(got[r.doc_id].expected_grade - expected) < 1e-6
        assert abs(got[r.doc_id].tail_probability - tails[sum(g < 1 for g in model.grades)]) < 1e-6
        assert got[r.doc_id].selected == (got[r.doc_id].tail_probability >= Q.MIN_PROBABILITY)
