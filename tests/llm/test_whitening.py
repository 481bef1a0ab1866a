import math

import numpy as np
import pytest

from quillstone.llm import whitening


def by_hand(rows, wanted=8):
    """By a dense eigendecomposition of the covariance."""
    kept = [(i, [math.floor(1024.0 * float(c)) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.int64)
    n, s = len(x), x.sum(0)
    centred = x - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, v), c in zip(kept, centred, strict=True):
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        for k in range(min(wanted, int((e > 1e-12 * e[0]).sum()))):
            out.setdefault((i, k + 1), []).append((n, deviation, c @ u[:, k] / math.sqrt(e[k]), e[k] / np.trace(cov)))
    return out


def compared(found, expected):
    assert sorted((r.vec_id, r.component) for r in found) == sorted(k for k, v in expected.items() for _ in v)
    signs = {}
    for r in found:
        n, deviation, w, share = expected[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained - share) < 1e-10 and r.identity_error < 1e-9
        if abs(w) > 1e-3:
            assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(r.whitened) - abs(w)) < 1e-8


def test_query_equals_a_dense_decomposition(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compared(whitening.op12_whitening(spark, sf_dir).collect(), by_hand(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (62, [float("nan")] * 5), (63, [float("inf")] + [0.0] * 4), (64, [0.0] * 5), (64, [0.0] * 5)]
    table = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<double>, component int, x string").repartition(3)
    compared(whitening.whiten(table).collect(), by_hand(rows))


def test_few_directions_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((40, 2)) @ rng.standard_normal((2, 6))
    rows = [(i, np.rint(v * 4).tolist()) for i, v in enumerate(flat)] + [(100 + i, [float(i), float(i * i % 5)]) for i in range(9)] + [(200, []), (201, [1.0, 2.0, 3.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    compared([r for r in out if r.vec_id < 100], by_hand(rows[:40]))
    compared([r for r in out if r.vec_id >= 100], by_hand(rows[40:49]))
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(2, [])], schema)).collect() == []


@pytest.mark.parametrize("length,basis,spread", [(200, 40, 0.9), (200, 512, 0.9), (64, 512, 1.0), (7, 512, 0.5), (300, 48, 0.95)])
def test_restarts_and_residuals(length, basis, spread):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((length, length)))
    values = 50 * spread ** np.arange(length)
    matrix = (q * values) @ q.T
    found, vectors = whitening.components(lambda b: matrix @ b, length, most_basis=basis)
    k = min(8, length)
    assert np.allclose(found, values[:k], rtol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10


def test_breakdown_of_the_block():
    """Three directions vary; the first products already span them, and the rest of the block vanishes."""
    matrix = np.zeros((50, 50))
    matrix[[3, 7, 9], [3, 7, 9]] = 5, 2, 2
    found, vectors = whitening.components(lambda b: matrix @ b, 50, block=2)
    assert np.allclose(found[:3], [5, 2, 2]) and np.allclose(found[3:], 0, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


def test_deviations_beyond_63_bits_are_an_error():
    x = np.array([[1 << 40, 0], [0, 0]], np.int64)
    with pytest.raises(OverflowError):
        whitening._exact_deviation(x, 2, x.sum(0))
    assert whitening._exact_deviation(x >> 20, 2, (x >> 20).sum(0)).tolist() == [1 << 40, 1 << 40]
