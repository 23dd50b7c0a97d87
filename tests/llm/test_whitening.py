import math

import numpy as np
import pytest
from conftest_llm import SF_DIR

from occugrid.llm import qd, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id int, whitened double, n long"


def frame(spark, vectors):
    rows = [(i, v, "x", 1, 0.0, 3) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def grid(vectors):
    out = []
    for i, v in vectors:
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        out.append((i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]))
    return out


def check(rows, vectors, components=16):
    """Every column against a plain covariance in numpy; directions by their sign."""
    kept = grid(vectors)
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), [sum(column) for column in zip(*fit.tolist(), strict=True)]
    centred = np.array([[int(n * a - s) for a, s in zip(x, sums, strict=True)] for x in fit.tolist()], float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(components, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    found = {}
    for r in rows:
        found.setdefault((r.vec_id, r.deviation), []).append(r)
    exact = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), x) for i, x in kept]
    assert len(rows) == k * len(kept)
    signs = {}
    for i, deviation, x in exact:
        own = found[i, deviation]
        mean = np.array([float(n * a - s) for a, s in zip(x, sums, strict=True)]) / n
        for r in own:
            j = r.component - 1
            assert r.n == n and 0 <= r.identity_error < 1e-4
            assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
            w = mean @ directions[:, j] / math.sqrt(values[j])
            gaps = np.abs(np.delete(values, j) - values[j])
            if gaps.min(initial=np.inf) > 1e-3 * values[j] and abs(w) > 1e-3:
                sign = signs.setdefault(j, np.sign(w * r.whitened))
                assert sign * r.whitened == pytest.approx(w, rel=1e-6, abs=1e-8)
    return k


def run(spark, vectors, components=16):
    points = whitening.fixed_point(frame(spark, vectors))
    model, distinct = whitening.fit(points, components)
    error = whitening.identity_error(model, distinct)
    return whitening.components(whitening.transform(points, model), model, error).collect()


def test_query_against_numpy(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    found = queries.QUERIES["op12_embedding_whitening"](spark, SF_DIR)
    assert found.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    assert check(found.collect(), [(r.vec_id, r.embedding) for r in table]) == 16


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    vectors += [(None, [1.0, 2.0, 3.0, 4.0]), (7, [0.5] * 4), (7, [0.5] * 4), (8, [1e4, -1e4, 0.0, 0.0])]
    vectors += [(90, None), (91, [1.0, None, 0.0, 0.0]), (92, [nan, 0.0, 0.0, 0.0]), (93, [0.0, -inf, 0.0, 0.0])]
    rows = run(spark, vectors)
    assert {r.vec_id for r in rows} == {*range(40), None}
    assert sum(r.vec_id == 7 for r in rows) == 3 * 4
    assert check(rows, vectors) == 4


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_vectors(spark, n):
    vectors = [(i, [float(i), 2.0 * i * i, 1.0]) for i in range(n)] * 2
    rows = run(spark, vectors)
    assert len(rows) == max(0, n - 1) * 2 * n
    if n > 1:
        assert check(rows, vectors) == n - 1


def test_empty_vectors_and_other_lengths(spark):
    assert run(spark, [(1, []), (2, [])]) == []
    with pytest.raises(ValueError, match="one length"):
        run(spark, [(1, [1.0]), (2, [1.0, 2.0])])


def test_equal_and_missing_variances(spark):
    corners = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1), 5.0]) for i in range(8)]
    rows = run(spark, corners)
    assert check(rows, corners) == 3
    w = np.array([[r.whitened for r in rows if r.component == c] for c in (1, 2, 3)])
    assert np.allclose(w @ w.T / 8, np.eye(3), atol=1e-12)


def test_a_tree_of_factors_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, [0.25] * 6) for i in range(200)]
    points = whitening.fixed_point(frame(spark, vectors).repartition(9))
    model, distinct = whitening.fit(points.repartition(9), 4)
    assert distinct.count() == len({tuple(x) for _, x in grid(vectors)})
    error = whitening.identity_error(model, distinct)
    rows = whitening.components(whitening.transform(points, model), model, error).collect()
    assert check(rows, vectors, 4) == 4


def test_a_deviation_beyond_a_long(spark):
    vectors = [(i, [float(i)]) for i in range(9)] + [(9, [1e7])]
    assert {r.vec_id for r in run(spark, vectors) if r.deviation is None} == {9}


def test_sums_beyond_a_long_stay_exact():
    n, sums = 10**10, tuple(10**10 * 10**9 + k for k in range(3))
    model = whitening.Whitening(n, sums, np.eye(3), np.ones(3), 3.0)
    x = np.array([[10**9, 10**9 + 1, 10**9 - 5]])
    exact = [n * int(a) - s for a, s in zip(x[0], sums, strict=True)]
    assert model.deviations(x).tolist() == [exact]
    assert model.squares(x) == [sum(d * d for d in exact)]


def matrices():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield from (np.triu(rng.normal(size=(n, n))) for n in (1, 2, 3, 30, 64))
    yield from (np.eye(20), np.zeros((5, 5)), np.outer(np.arange(6.0), np.ones(6)))
    yield q @ np.diag([5.0] * 10 + [1.0] * 20 + [0.0] * 10) @ q.T
    yield q @ np.diag(np.r_[np.ones(20) + 1e-9 * np.arange(20), np.full(20, 0.1)]) @ q.T
    yield q @ np.diag(10.0 ** -np.arange(40)) @ q.T
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 20))
        yield np.linalg.qr(rng.integers(-2, 3, size=(n, n)).astype(float))[1]


def test_solver_against_numpy():
    for matrix in matrices():
        squared, vectors = qd.right_singular(matrix, 16)
        plain = np.linalg.svd(matrix, compute_uv=False) ** 2
        top = max(float(plain[0]), 1e-300)
        assert np.allclose(squared, plain, rtol=1e-12, atol=1e-12 * top)
        k = vectors.shape[1]
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-11)
        assert np.abs(matrix.T @ (matrix @ vectors) - vectors * squared[:k]).max(initial=0) < 1e-11 * top


def test_small_singular_values_keep_their_digits():
    """What a covariance would lose: values far below the square root of the precision."""
    diagonal, above = 10.0 ** -np.arange(0, 40, 4.0), 0.5 * 10.0 ** -np.arange(1, 37, 4.0)
    squared = qd.squared_singular_values(diagonal, above)
    assert np.prod(squared) == pytest.approx(np.prod(diagonal) ** 2, rel=1e-12)
    assert squared[-1] < 1e-60
