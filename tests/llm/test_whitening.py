import numpy as np
import pytest

from tallyloom.llm import whitening as W


def brute(vectors):
    """x, the fit list's mean and covariance, its eigenvalues falling and eigenvectors, from whole matrices."""
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    exact = [sum(int(v) for v in c) for c in fit.T]
    y = np.array([[len(fit) * int(v) - s for v, s in zip(r, exact, strict=True)] for r in fit], np.float64) / len(fit)
    values, turn = np.linalg.eigh(y.T @ y / len(fit))
    return x, fit, exact, values[::-1], turn[:, ::-1]


def table_of(spark, vectors, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v], 1, "c") for i, v in enumerate(vectors)] + list(extra), "vec_id bigint, embedding array<double>, n int, component string")


@pytest.mark.parametrize("n, dims", [(700, 24), (400, 64), (60, 5), (12, 40)])
def test_equals_whole_matrices(spark, n, dims):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, dims)) * np.linspace(0.2, 3, dims) + rng.standard_normal(dims) * 5).astype(np.float32)
    vectors[n // 2 :: 3] = vectors[0]
    odd = [(900, None, 1, "c"), (901, [None] + [0.0] * (dims - 1), 1, "c"), (902, [float("nan")] * dims, 1, "c"), (903, [float("-inf")] * dims, 1, "c"), (904, [1.0] * (dims + 1), 1, "c"), (905, [], 1, "c"), (None, [float(c) for c in vectors[1]], 1, "c"), (3, [float(c) for c in vectors[2]], 1, "c")]
    got = W.whitened(table_of(spark, vectors, odd)).toPandas()
    x, fit, exact, values, turn = brute(vectors)
    k = min(16, dims, int((values > 1e-9 * values.sum()).sum()))
    assert len(got) == (n + 2) * k and set(got.component) == set(range(1, k + 1)) and set(got.n) == {len(fit)}
    assert np.allclose(got.groupby("component").explained.first(), values[:k] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8
    deviation = [sum((len(fit) * int(v) - s) ** 2 for v, s in zip(r, exact, strict=True)) for r in x]
    first = got[(got.vec_id < 900) & (got.vec_id != 3)].sort_values(["vec_id", "component"])
    ids = first.vec_id.unique().astype(int)
    assert first.deviation.values[::k].tolist() == [deviation[i] for i in ids]
    mine = first.whitened.values.reshape(-1, k)
    want = ((x[ids] - np.array([s / len(fit) for s in exact])) @ turn[:, :k]) / np.sqrt(values[:k])
    sign = np.sign((mine * want).sum(axis=0))
    assert np.allclose(mine * sign, want, atol=1e-5)


def test_solver_certifies_close_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.concatenate([[10, 10, 10 - 1e-6, 9.999], np.linspace(5, 1e-3, 296)])
    v = (q * values) @ q.T
    seen = []
    got, x, steps = W.lobpcg(lambda b: seen.append(b.shape[1]) or v @ b, 300, 6, 1e-12, 400)
    assert np.allclose(got, values[:6], rtol=1e-11) and np.linalg.norm(v @ x - x * got, axis=0).max() <= 1e-11
    assert max(seen) <= 30 and steps < 200
    with pytest.raises(ArithmeticError):
        W.lobpcg(lambda b: v @ b, 300, 6, 1e-12, 2)


def test_tables_without_components(spark):
    empty = table_of(spark, np.zeros((0, 4)))
    assert W.whitened(empty).count() == 0
    assert W.whitened(table_of(spark, np.ones((5, 3)))).count() == 0
    assert W.whitened(table_of(spark, [], [(1, None, 1, "c")])).count() == 0
    assert W.whitened(table_of(spark, [[1.0], [2.0], [2.0]])).count() == 3


def test_entries_of_any_size(spark):
    got = W.whitened(table_of(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]])).toPandas()
    assert len(got) == 3 and np.isfinite(got.whitened).all()
    assert got.sort_values("vec_id").deviation.isna().tolist() == [True, True, False]


def test_query_over_its_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    rows = rows[[v is not None and all(c is not None and np.isfinite(c) for c in v) for v in rows.embedding]]
    x, fit, exact, values, turn = brute(np.stack(rows.embedding.values))
    got = W.op11_whitening(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(got.vec_id) == sorted(np.repeat(rows.vec_id.values, 16)) and set(got.n) == {len(fit)}
    at = {v: r for v, r in zip(rows.vec_id, ((x - np.array([s / len(fit) for s in exact])) @ turn[:, :16]) / np.sqrt(values[:16]), strict=True)}
    sums = {v: sum((len(fit) * int(c) - s) ** 2 for c, s in zip(r, exact, strict=True)) for v, r in zip(rows.vec_id, x, strict=True)}
    assert (got.deviation == got.vec_id.map(sums)).all()
    got["want"] = [at[v][k - 1] for v, k in zip(got.vec_id, got.component, strict=True)]
    sign = np.sign((got.want * got.whitened).groupby(got.component).sum())
    assert np.allclose(got.whitened * got.component.map(sign), got.want, atol=1e-6)
