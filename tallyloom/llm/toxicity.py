"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over hashed distinct words is trained in numpy from confirmed toxic texts and unlabelled texts. The risk of the negative class is that of the unlabelled texts less the prior times that of the positives; where this estimate falls below zero, the step goes the other way, so that the model doesn't learn the unlabelled texts by heart. The prior is the share of toxic rows among the labels open to training.

Words take part if the positives hold them clearly more often than the unlabelled texts do (SCREEN standard deviations); this keeps the model from learning single texts by their rare words.

Training takes at most MAX_POSITIVE and MAX_UNLABELLED texts, the first by hash of the id. Everything else covers all rows.

Defined results: null and empty texts score as a text without words; a null id is not held out; labels that repeat an id count as toxic if one is; without toxic labels every score is 0; rows that repeat an id are scored one by one; an empty table gives no rows; no column but the text is an input of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_rows, bound_batches, slices, table, text_or_empty
from tallyloom.llm.decontaminate import words
from tallyloom.llm.hashedtext import SIZE, Adam, Sparse, WordWeights, first_ids, sigmoid, slot, vectors

MAX_POSITIVE, MAX_UNLABELLED = 4_000, 10_000
ROUNDS, RATE, DECAY = 150, 0.05, 1e-4
SCREEN, MIN_HOLDERS = 4.0, 3
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def vectorize(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One for each distinct word."""
    slots = np.array(sorted(slot(w) for w in set(words(text))), np.int32)
    return slots, np.ones(len(slots))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train(positive: Sparse, unlabelled: Sparse, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk."""
    weights, bias = np.zeros(SIZE), float(np.log(prior / (1 - prior)))
    by_weight, by_bias = Adam(SIZE, RATE), Adam(1, RATE / 5)
    for _ in range(ROUNDS):
        zp, zu = positive.score(weights) + bias, unlabelled.score(weights) + bias
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        # slopes of the negative risk, and of the positive one
        up, uu = -prior * sigmoid(zp) / positive.n, sigmoid(zu) / unlabelled.n
        if negative >= 0:
            up = up - prior * sigmoid(-zp) / positive.n
        else:
            up, uu = -up, -uu
        weights -= by_weight.step(positive.pull(up) + unlabelled.pull(uu) + DECAY * weights)
        bias -= float(by_bias.step(np.array([up.sum() + uu.sum()]))[0])
    return weights, bias


def screened(positive: list, unlabelled: list) -> np.ndarray:
    """Which slots take part."""
    held, among = (np.bincount(np.concatenate([s for s, _ in rows]), minlength=SIZE) for rows in (positive, unlabelled))
    expected = (among + 1) / (len(unlabelled) + 1) * len(positive)
    return (held >= MIN_HOLDERS) & (held - expected > SCREEN * np.sqrt(expected))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray, float] | None:
    """The model, from labels that are not held out; None without toxic ones."""
    open_labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null and toxic is not null")
    prior = open_labels.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    p_ids = first_ids(open_labels.where("toxic = 1").join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id"), max_positive)
    u_ids = first_ids(docs.where(~held_out(F.col("doc_id"))).select("doc_id"), max_unlabelled)
    if not p_ids:
        return None
    rows = vectors(docs, sorted({*p_ids, *u_ids}), vectorize)
    positive, unlabelled = [rows[i] for i in p_ids], [rows[i] for i in u_ids]
    part = screened(positive, unlabelled)
    cut = lambda rows: Sparse([(s[part[s]], v[part[s]]) for s, v in rows])
    return train(cut(positive), cut(unlabelled), min(max(prior, 0.001), 0.999))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    bound_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(None if model is None else (model[0].astype("f4"), model[1]))
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cast.value
        weigh = WordWeights(known[0], lambda w: [w]) if known else None
        for batch in slices(batches, 2):
            z = []
            for text in batch.column(2).to_pylist() if weigh is not None else ():
                distinct = set(words(text))
                z.append(sum(map(weigh.__getitem__, distinct)) + known[1])
            scores = sigmoid(np.array(z)) if weigh is not None else np.zeros(batch.num_rows)
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
            yield arrow_rows({"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": (scores >= threshold).astype("i4")}, schema)

    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
