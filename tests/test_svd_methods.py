"""Tall-skinny QR, block Krylov and the noise floor of the Gram path, against numpy."""

import numpy as np
import pytest

from rowmill.operators import blocks, svd


def frame(spark, a, parts=5):
    return spark.createDataFrame([(row.tolist(),) for row in a], "features array<double>").repartition(parts)


def graded(n, d, ratio, seed=3):
    """Singular values 1, ratio, ratio², ..."""
    g = np.random.default_rng(seed)
    u, _ = np.linalg.qr(g.standard_normal((n, d)))
    v, _ = np.linalg.qr(g.standard_normal((d, d)))
    return (u * ratio ** np.arange(d)) @ v.T


@pytest.mark.parametrize("fan", [2, 16])
def test_tsqr_has_small_singular_values(spark, fan, monkeypatch):
    monkeypatch.setattr(svd, "FAN_IN", fan)
    monkeypatch.setattr(svd, "DRIVER_FACTORS", 2 * 12 * 12 * 8)           # forces the tree
    a = graded(300, 12, 0.1)
    res = svd.truncated_svd(frame(spark, a, 9), "features", 12, 12, method="tsqr")
    want = np.linalg.svd(a, compute_uv=False)
    assert res.sigma.size == 12 and np.abs(res.sigma - want).max() <= 1e-12 * want[0]
    assert np.abs(np.log10(res.sigma[:11] / 0.1 ** np.arange(11))).max() < 1e-3
    assert np.abs(res.V.T @ res.V - np.eye(12)).max() < 1e-12


@pytest.mark.parametrize("method", ["gram", "tsqr", "auto"])
def test_rank_two_has_two_factors(spark, method):
    g = np.random.default_rng(1)
    a = g.standard_normal((200, 2)) @ g.standard_normal((2, 12))
    res = svd.truncated_svd(frame(spark, a), "features", 10, 12, method=method)
    assert res.sigma.size == 2
    assert np.allclose(res.sigma, np.linalg.svd(a, compute_uv=False)[:2], rtol=1e-12)


def test_auto_tells_small_values_from_round_off(spark):
    a = graded(200, 12, 0.01)                                              # 1 ... 1e-22
    res = svd.truncated_svd(frame(spark, a), "features", 6, 12)
    assert res.method == "tsqr" and res.sigma.size == 6
    assert np.allclose(res.sigma, 0.01 ** np.arange(6), rtol=1e-4)
    assert svd.truncated_svd(frame(spark, a), "features", 3, 12).method == "gram"


def test_no_rows_and_few_rows(spark):
    assert svd.truncated_svd(frame(spark, np.zeros((0, 4))), "features", 2, 4, method="tsqr").sigma.size == 0
    a = np.arange(8.0).reshape(2, 4)
    res = svd.truncated_svd(frame(spark, a), "features", 4, 4, method="tsqr")
    assert np.allclose(res.sigma, np.linalg.svd(a, compute_uv=False))
    assert svd.truncated_svd(frame(spark, np.zeros((3, 4))), "features", 2, 4, method="tsqr").sigma.size == 0
    with pytest.raises(Exception, match="finite"):
        svd.truncated_svd(frame(spark, np.full((2, 2), np.nan)), "features", 1, 2, method="tsqr")


@pytest.mark.parametrize("n,d,k,ratio", [(400, 60, 5, 0.9), (90, 200, 4, 0.97), (50, 8, 8, 0.5)])
def test_krylov_in_few_passes(spark, n, d, k, ratio):
    m = min(n, d)
    a = graded(n, m, ratio) if n >= d else graded(d, m, ratio).T
    res = svd.truncated_svd(frame(spark, a), "features", k, d, method="krylov", oversample=4)
    want = np.linalg.svd(a, compute_uv=False)
    assert res.converged and res.passes <= 30
    assert np.allclose(res.sigma, want[:k], rtol=1e-8)
    assert np.abs(a.T @ (a @ res.V) - res.V * res.sigma ** 2).max() < 1e-8


def test_krylov_restarts(spark, monkeypatch):
    monkeypatch.setattr(svd, "MAX_BASIS", 3)
    a = graded(300, 90, 0.985)
    res = svd.truncated_svd(frame(spark, a), "features", 3, 90, method="krylov", oversample=3, iterations=90)
    assert res.converged and np.allclose(res.sigma, 0.985 ** np.arange(3), rtol=1e-8)


def test_krylov_of_a_rank_two_matrix(spark):
    g = np.random.default_rng(1)
    a = g.standard_normal((200, 2)) @ g.standard_normal((2, 40))
    res = svd.truncated_svd(frame(spark, a), "features", 5, 40, method="krylov")
    assert res.converged and res.sigma.size == 2 and res.passes <= 3


def test_wide_partials_are_added_up_before_the_shuffle(spark):
    """One task a core for wide partials, four for narrow ones."""
    df = spark.range(0, 1000, numPartitions=64).selectExpr("array(cast(id as double)) AS features")
    cores = spark.sparkContext.defaultParallelism
    assert blocks.prepare(df, ["features"], 1000).partitions == 4 * cores
    assert blocks.prepare(df, ["features"], blocks.WIDE_PARTIAL).partitions == cores
