"""Hashed features of texts, and what the two classifiers share: bounded samples, sparse batches, cached word weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty

BITS = 18
SIZE = 1 << BITS
CHUNK = 1 << 20
#: Words whose weights a worker remembers since it last set its memory aside (some 15 MB; as much is set aside).
REMEMBERED = 80_000


def slot(token: bytes) -> int:
    return (zlib.crc32(token) * 0x9E3779B1 >> 7) & (SIZE - 1)


class Sparse:
    """Rows of (slots, values) laid end to end; sums go over some CHUNK entries at a time, so they need little beside the rows."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.slots = np.concatenate([i for i, _ in rows] or [np.zeros(0)]).astype(np.int32)
        self.values = np.concatenate([v for _, v in rows] or [np.zeros(0)]).astype(np.float32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(i) for i, _ in rows])
        self.chunks = [slice(at, at + CHUNK) for at in range(0, len(self.slots), CHUNK)]

    def score(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for c in self.chunks:
            first = int(self.row[c][0])
            part = np.bincount(self.row[c] - first, self.values[c] * weights[self.slots[c]])
            out[first : first + len(part)] += part
        return out

    def pull(self, by_row: np.ndarray) -> np.ndarray:
        """Gradient by weight from the gradient by row."""
        out = np.zeros(SIZE)
        for c in self.chunks:
            out += np.bincount(self.slots[c], self.values[c] * by_row[self.row[c]], SIZE)
        return out


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class WordWeights(dict):
    """The summed weight of a word's features, worked out once a word. Words that are still in use come back from the memory set aside."""

    def __init__(self, weights: np.ndarray, features: Callable[[bytes], list[bytes]]):
        super().__init__()
        self.weights, self.features, self.aside = weights, features, {}

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.aside = dict(self)
            self.clear()
        value = self.aside.get(word)
        if value is None:
            value = float(sum(self.weights[slot(f)] for f in self.features(word)))
        self[word] = value
        return value


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def first_ids(ids: DataFrame, limit: int) -> list:
    """At most `limit` ids of a one-column table, those first by hash: the same on every run and at every size of cluster."""
    name = ids.columns[0]
    rows = ids.where(F.col(name).isNotNull()).distinct().orderBy(F.xxhash64(F.col(name)), F.col(name)).limit(limit)
    return sorted(r[0] for r in rows.collect())


def vectors(docs: DataFrame, ids: list, vectorize: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> dict:
    """id -> (slots, values) for a bounded list of ids; of rows that repeat an id, the smallest text counts."""
    if not ids:
        return {}
    kind = docs.schema["doc_id"].dataType
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind.simpleString()}")
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [vectorize(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
                ["doc_id", "slots", "weights"],
            )

    got = chosen.mapInArrow(run, f"doc_id {kind.simpleString()}, slots binary, weights binary").collect()
    return {r.doc_id: (np.frombuffer(r.slots, "<i4"), np.frombuffer(r.weights, "<f4")) for r in sorted(got, key=lambda r: r.doc_id)}
