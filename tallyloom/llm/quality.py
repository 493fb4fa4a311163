"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text gives a document's place on a line; ordered thresholds cut the line into grades: P(grade >= k) = sigmoid(place - threshold_k). From the same model come the expected grade and the probability of at least a wanted grade, by which documents are selected. Two grades are the plain case of one threshold.

Features are words, their shapes (kinds of characters, run-length free) and marks of the whole text (repetition of neighbours, share of distinct words), all hashed. Training takes at most MAX_RATED rated documents, the first by hash of the id; scoring covers all rows.

Defined results: null and empty texts score as a text without words; of ratings that repeat an id the lowest counts, null ratings are ignored; without ratings, or with one grade only, every document gets that grade (0 without any); rows that repeat an id are scored one by one; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_rows, bound_batches, slices, table, text_or_empty
from tallyloom.llm.hashedtext import SIZE, Adam, Sparse, WordWeights, first_ids, sigmoid, slot, vectors

MAX_RATED = 12_000
ROUNDS, RATE, DECAY = 150, 0.2, 1e-5
#: Weight of a text's share of one feature, and of a mark of the whole text.
SHARE, MARK = 4.0, 0.5
MIN_PROBABILITY = 0.5

_SHAPE = bytes(
    ord("l") if 97 <= c <= 122 else ord("u") if 65 <= c <= 90 else ord("d") if 48 <= c <= 57 else ord("x") if c >= 128 else c
    for c in range(256)
)


def shape(word: bytes) -> bytes:
    mapped = word.translate(_SHAPE)
    return bytes(c for k, c in enumerate(mapped) if not k or c != mapped[k - 1])


def word_features(word: bytes) -> list[bytes]:
    return [b"w " + word.lower(), b"s " + shape(word)]


def text_marks(words: list[bytes]) -> list[bytes]:
    """Marks of the whole text, in steps."""
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    size = len(words).bit_length()
    return [b"again %d" % int(again * 20), b"distinct %d %d" % (size, int(10 * len(set(words)) / n)), b"size %d" % size]


def vectorize(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    sums: dict[int, float] = {}
    for word, k in Counter(words).items():
        for f in word_features(word):
            sums[slot(f)] = sums.get(slot(f), 0.0) + SHARE * k / len(words)
    for f in text_marks(words):
        sums[slot(f)] = sums.get(slot(f), 0.0) + MARK
    slots = sorted(sums)
    return np.array(slots, np.int32), np.array([sums[s] for s in slots])


class Ordinal(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list


def train(rows: Sparse, grade: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of greatest likelihood. Gaps between thresholds are exponentials, so they stay ordered."""
    weights, k = np.zeros(SIZE), n_grades - 1
    above = np.clip([(grade >= j).mean() for j in range(1, n_grades)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(k))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    by_weight, by_raw = Adam(SIZE, RATE), Adam(k, RATE / 5)
    at = np.arange(rows.n)
    for _ in range(ROUNDS):
        thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        tail = np.ones((rows.n, n_grades + 1))
        tail[:, 1:n_grades] = sigmoid(rows.score(weights)[:, None] - thresholds)
        tail[:, n_grades] = 0
        slope = tail * (1 - tail)
        p = np.maximum(tail[at, grade] - tail[at, grade + 1], 1e-9)
        by_row = -(slope[at, grade] - slope[at, grade + 1]) / p / rows.n
        by_threshold = np.zeros(n_grades + 1)
        np.add.at(by_threshold, grade, slope[at, grade] / p / rows.n)
        np.add.at(by_threshold, grade + 1, -slope[at, grade + 1] / p / rows.n)
        later = np.cumsum(by_threshold[1:n_grades][::-1])[::-1]
        raw -= by_raw.step(later * np.concatenate([[1.0], np.exp(raw[1:])]))
        weights -= by_weight.step(rows.pull(by_row) + DECAY * weights)
    return weights, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", max_rated: int = MAX_RATED) -> Ordinal:
    """The model from ratings (doc_id, grade), grades being any ordered integers."""
    rated = ratings.select("doc_id", F.col(grade_col).cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = first_ids(rated.select("doc_id"), max_rated)
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind}")
    grade_of = {r.doc_id: r.grade for r in rated.join(F.broadcast(wanted), "doc_id").collect()}
    grades = sorted(set(grade_of.values()))
    if len(grades) < 2:
        return Ordinal(np.zeros(SIZE), np.zeros(0), grades or [0])
    rows = vectors(docs, ids, vectorize)
    y = np.array([grades.index(grade_of[i]) for i in rows])
    return Ordinal(*train(Sparse(list(rows.values())), y, len(grades)), grades)


def grade_texts(model: Ordinal, batches: Iterator[list[bytes]], min_grade: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Expected grade and P(grade >= min_grade) of each text, batch by batch."""
    weigh = WordWeights(model.weights, word_features)
    grades = np.array(model.grades, float)
    wanted = sum(g < min_grade for g in model.grades)
    for texts in batches:
        place = []
        for text in texts:
            words = text.split()
            mark = MARK * sum(float(model.weights[slot(f)]) for f in text_marks(words))
            place.append(SHARE * sum(map(weigh.__getitem__, words)) / max(1, len(words)) + mark)
        tail = np.zeros((len(texts), len(grades) + 1))
        tail[:, 0] = 1
        tail[:, 1 : len(grades)] = sigmoid(np.array(place)[:, None] - model.thresholds)
        yield (tail[:, :-1] - tail[:, 1:]) @ grades, tail[:, wanted]


def _shipped(docs: DataFrame, model: Ordinal):
    bound_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(Ordinal(model.weights.astype("f4"), model.thresholds, model.grades))


def score(docs: DataFrame, model: Ordinal, min_grade: int = 1, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of at least min_grade) and selected for every row of docs."""
    cast = _shipped(docs, model)
    source = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[bytes]]:
            for batch in slices(batches, 1):
                held.append(batch)
                yield batch.column(1).to_pylist()

        for expected, tail in grade_texts(cast.value, texts(), min_grade):
            batch = held.pop()
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("selected", pa.bool_())])
            yield arrow_rows({"doc_id": batch.column(0), "expected_grade": expected, "tail_probability": tail, "selected": tail >= min_probability}, schema)

    return source.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, selected boolean")


def select_good(docs: DataFrame, model: Ordinal, min_grade: int = 1, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The selected rows of docs, with all their columns."""
    cast, at = _shipped(docs, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[bytes]]:
            for batch in slices(batches, at):
                held.append(batch)
                yield [t.encode() if t else b"" for t in batch.column(at).to_pylist()]

        for _, tail in grade_texts(cast.value, texts(), min_grade):
            yield held.pop().filter(pa.array(tail >= min_probability))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
