"""Embedding whitening by LOBPCG, a block eigensolver that touches the rows only through covariance-block products.

Entries become whole numbers, x = floor(64 c) + 1000000, and each distinct x vector is in the fit list once. A first pass over the list sums it up exactly, so that rows can be centred before anything is multiplied: by a whole number first, which is exact, then by what the mean is above it. Every step of the solver sends three blocks, orthonormalised as one basis with what is dependent left out, to the tasks: the iterate, its residuals and the previous directions. It gets back the centred rows' product of V and the basis, summed by Spark; a Rayleigh-Ritz projection gives the next iterate. No product is carried on from earlier steps, so rounding doesn't add up. The steps end when the residuals V b - e b of all wanted components are below `tolerance` times the greatest eigenvalue, which certifies them; if `max_steps` don't get there, ArithmeticError is raised, as wrong components would be worse.

The driver holds blocks of (dimensions x three block widths) numbers, never rows, and every task the sums of such a block. Fit lists are written once as packed vectors in the shared folder; a pass over them is all that a lost executor costs.

Defined results: vectors that are null or hold null, infinite or undefined entries get no rows; nor do vectors whose length isn't the most frequent one (the greater on ties), as they have no place in the fit; entries beyond 2^40 count as 2^40 on either side; equal vectors get equal numbers and count once in the fit; rows that repeat an id, or have none, are all given; directions without variance (fewer distinct vectors than components, constant dimensions) are no components, so there may be fewer than asked for, or no rows at all; an empty table gives no rows; a deviation that a long can't hold is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import save, slices, table, workspace

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 40
#: Vectors beyond the wanted ones in a block: they make the last wanted ones converge.
GUARD = 4
#: Rows that a task turns into floating-point numbers at a time.
ROWS = 4096


@dataclass
class Fit:
    """Sums of a fit list of n vectors, and its leading components, one a column."""

    n: int
    base: np.ndarray  # whole numbers taken off each dimension first
    rest: np.ndarray  # the mean above base
    sums: list[int]  # exact, per dimension
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    steps: int = 0
    identity_error: float = 0.0

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole(raw: pa.Array, dims: int) -> np.ndarray:
    """Rows of x of a column of lists without nulls, all of dims entries."""
    c = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(np.clip(c, -LARGEST, LARGEST) * SCALE).astype(np.int64) + OFFSET


def usable(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows whose vector counts, and their dimensions."""
    fine = rows.where(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = fine.groupBy(F.size(vector_col).alias("dims")).agg(F.count(F.lit(1)).alias("n")).where("dims > 0")
    most = lengths.agg(F.max(F.struct("n", "dims")).alias("most")).first().most
    dims = most.dims if most else 0
    return fine.where(F.size(vector_col) == dims), dims


def fit_list(rows: DataFrame, vector_col: str, dims: int, path: str) -> DataFrame:
    """x: each distinct vector once, as packed longs. Equal vectors meet map-side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(batch.column(0), dims).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return save(rows.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "x binary").distinct(), path)


def _rows_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in slices(batches, 0):
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column(0).slice(at, ROWS).to_pylist()
            if part:
                yield np.frombuffer(b"".join(part), "<i8").reshape(-1, dims)


def _summed(fitted: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sums over the fit list of what `of` makes of its rows. A task gives one row a sum, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches, dims):
            total = of(x).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "part"])

    got = fitted.mapInArrow(run, f"k int, part {kind}").groupBy("k").agg(F.sum(F.col("part").cast("decimal(38,0)") if kind == "bigint" else "part").alias("total")).collect()
    return [r.total for r in sorted(got, key=lambda r: r.k)]


def covariance_times(fitted: DataFrame, n: int, base: np.ndarray, rest: np.ndarray, block: np.ndarray) -> np.ndarray:
    """V block, from the centred rows, without V."""
    dims, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((dims, width)), False
        for x in _rows_of(batches, dims):
            y = (x - base).astype(np.float64) - rest
            total += y.T @ (y @ block)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "part"])

    rows = fitted.mapInArrow(run, "k int, part array<double>").groupBy("k").agg(*[F.sum(F.get("part", F.lit(j))).alias(f"c{j}") for j in range(width)]).collect()
    out = np.zeros((dims, width))
    for r in rows:
        out[r.k] = r[1:]
    return out / n


def orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, first ones first, without those that depend on others. Each block is cleared of the basis twice, for rounding."""
    basis = blocks[0][:, :0]
    for block in blocks:
        for _ in range(2):
            before = np.linalg.norm(block, axis=0)
            block = block - basis @ (basis.T @ block)
            scale = np.linalg.norm(block, axis=0)
            keep = scale > 1e-8 * before
            block = block[:, keep] / scale[keep]
            values, turn = np.linalg.eigh(block.T @ block) if block.shape[1] else (np.zeros(0), np.zeros((0, 0)))
            block = block @ (turn[:, values > 1e-12] / np.sqrt(values[values > 1e-12]))
        basis = np.concatenate([basis, block], axis=1)
    return basis


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, tolerance: float, max_steps: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The greatest eigenvalues of a symmetric operator, falling, their vectors and the number of steps."""
    width = min(dims, wanted + GUARD)
    x = np.random.default_rng(0).standard_normal((dims, width))
    w = p = x[:, :0]
    best, since = np.inf, 0
    for step in range(1, max_steps + 1):
        basis = orthonormal([x, w, p])
        image = times(basis)
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        # the part of the new iterate outside the old one is the next step's previous direction
        p = basis[:, width:] @ turn[width:]
        x = basis @ turn
        w = image @ turn - x * values
        top, error = max(float(values[0]), 0.0), float(np.linalg.norm(w[:, :wanted], axis=0).max(initial=0.0))
        best, since = (error, 0) if error < 0.5 * best else (best, since + 1)
        # rounding ends the descent somewhere below the tolerance: the steps go on to that floor
        if error <= tolerance * top and (since or error <= 1e-15 * top):
            return values[:wanted], x[:, :wanted], step
    raise ArithmeticError(f"LOBPCG: residual {best:.3g} after {max_steps} steps, wanted {tolerance:.3g} of {top:.3g}")


def fit(fitted: DataFrame, dims: int, components: int = 16, tolerance: float = 1e-12, max_steps: int = 200) -> Fit:
    n, *sums = [int(v) for v in _summed(fitted, dims, lambda x: np.insert(x, 0, 1, axis=1), "bigint")] or [0] * (dims + 1)
    base = np.array([s // max(n, 1) for s in sums], np.int64)
    rest = np.array([(s - n * int(b)) / max(n, 1) for s, b in zip(sums, base.tolist(), strict=True)])
    trace = sum(_summed(fitted, dims, lambda x: np.square((x - base).astype(np.float64) - rest), "double")) / max(n, 1)
    if n == 0 or trace <= 0:
        return Fit(n, base, rest, sums, trace, np.zeros(0), np.zeros((dims, 0)))
    values, vectors, steps = lobpcg(lambda b: covariance_times(fitted, n, base, rest, b), dims, min(components, dims), tolerance, max_steps)
    real = values > 1e-12 * trace
    out = Fit(n, base, rest, sums, trace, values[real], vectors[:, real], steps)
    scaled = out.scaled
    out.identity_error = float(np.abs(scaled.T @ covariance_times(fitted, n, base, rest, scaled) - np.eye(scaled.shape[1])).max(initial=0.0))
    return out


def whiten(rows: DataFrame, model: Fit, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per row and component: id, component, n, deviation, whitened, explained, identity_error. Rows stay where they are."""
    n, base, rest, width = model.n, model.base, model.rest, len(model.values)
    scaled, explained = model.scaled, model.values / (model.trace or 1.0)
    over = np.array([s - n * int(b) for s, b in zip(model.sums, base.tolist(), strict=True)], object)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def deviations(y: np.ndarray) -> list:
        """Sums of (n x - S)^2 = (n y - over)^2, in whole numbers."""
        most = n * int(np.abs(y).max(initial=0)) + int(max(map(abs, over), default=0))
        if dims * most * most < 1 << 63:
            return (np.square(n * y - over.astype(np.int64)).sum(axis=1)).tolist()
        return [d if (d := sum((n * v - o) ** 2 for v, o in zip(row, over, strict=True))) < 1 << 63 else None for row in y.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if width else 0, ROWS):
                part = batch.slice(at, ROWS)
                y = whole(part.column(1), dims) - base
                m = len(y)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), width))),
                        pa.array(np.tile(np.arange(1, width + 1), m), pa.int32()),
                        pa.array(np.full(m * width, n), pa.int64()),
                        pa.array(deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), width))),
                        pa.array(((y.astype(np.float64) - rest) @ scaled).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * width, model.identity_error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, schema)


def whitened(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """Fit on the distinct vectors of rows, then whiten every row."""
    root = workspace(rows.sparkSession, "whitening")
    fine, dims = usable(rows.select(id_col, vector_col), vector_col)
    if not dims:
        return whiten(fine, Fit(0, np.zeros(0, np.int64), np.zeros(0), [], 0.0, np.zeros(0), np.zeros((0, 0))), 0, id_col, vector_col)
    return whiten(fine, fit(fit_list(fine, vector_col, dims, f"{root}/fit"), dims, components, **options), dims, id_col, vector_col)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
