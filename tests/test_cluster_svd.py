"""k-means, NMI and SVD against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.operators import kmeans, nmi, svd


def lloyd(x, centers, iters):
    for _ in range(iters):
        d = ((x[:, None, :] - centers[None]) ** 2).sum(-1)
        a = d.argmin(1)
        new = centers.copy()
        for c in range(centers.shape[0]):
            if (a == c).any():
                new[c] = x[a == c].mean(0)
        centers = new
    return centers


def test_kmeans_matches_numpy_lloyd(emb, emb_np):
    _, _, x = emb_np
    fit = kmeans.kmeans_fit(emb, "features", 5, 64, max_iter=8, order_by="id", epsilon=0.0)
    want = lloyd(x, x[:5].copy(), fit.iterations)
    assert np.allclose(fit.centers, want, atol=1e-12)
    costs = fit.cost_history
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))


def test_empty_cluster_keeps_centre(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])],
                               "id long, features array<double>")
    far = [[0.0, 0.0], [100.0, 0.0]]
    fit = kmeans.kmeans_fit(df, "features", 2, 2, max_iter=3, init="given", initial_centers=far)
    assert fit.centers[1].tolist() == [100.0, 0.0]


def test_tie_goes_to_lowest_cluster(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0])], "id long, features array<double>")
    out = kmeans.assign(df, "features", [[1.0, 0.0], [-1.0, 0.0]], keep=["id"]).first()
    assert out["prediction"] == 0


def test_parallel_init_runs(emb):
    fit = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=5, init="k-means||", seed=1)
    assert fit.centers.shape == (4, 64) and np.isfinite(fit.centers).all()


def nmi_np(u, v):
    from collections import Counter
    n = len(u)
    cu, cv, cuv = Counter(u), Counter(v), Counter(zip(u, v))
    mi = sum(c / n * np.log(c * n / (cu[a] * cv[b])) for (a, b), c in cuv.items())
    hu = -sum(c / n * np.log(c / n) for c in cu.values())
    hv = -sum(c / n * np.log(c / n) for c in cv.values())
    return mi, hu, hv


def test_nmi_properties(spark):
    rng = np.random.default_rng(0)
    u = rng.integers(0, 4, 300)
    v = (u + rng.integers(0, 2, 300)) % 5
    df = spark.createDataFrame([(int(a), int(b), int((a + 1) % 4)) for a, b in zip(u, v)], "u int, v int, w int")
    row = nmi.nmi(df, "u", "v").first()
    mi, hu, hv = nmi_np(list(u), list(v))
    assert row["mi"] == pytest.approx(mi, abs=1e-12)
    assert row["nmi_geometric"] == pytest.approx(mi / np.sqrt(hu * hv), abs=1e-12)
    assert row["nmi_arithmetic"] == pytest.approx(2 * mi / (hu + hv), abs=1e-12)
    sym = nmi.nmi(df, "v", "u").first()
    assert sym["nmi_geometric"] == pytest.approx(row["nmi_geometric"], abs=1e-12)
    assert nmi.nmi(df, "u", "u").first()["nmi_arithmetic"] == pytest.approx(1.0)
    assert nmi.nmi(df, "u", "w").first()["nmi_geometric"] == pytest.approx(1.0)  # relabelled


def test_nmi_constant_limits(spark):
    both = spark.createDataFrame([(1, 1)] * 5, "u int, v int")
    assert nmi.nmi(both, "u", "v").first()["nmi_geometric"] == 1.0
    one = spark.createDataFrame([(1, i % 2) for i in range(6)], "u int, v int")
    r = nmi.nmi(one, "u", "v").first()
    assert r["nmi_geometric"] == 0.0 and r["nmi_arithmetic"] == 0.0


def test_svd_against_numpy(emb, emb_np):
    _, _, x = emb_np
    res = svd.truncated_svd(emb, "features", 10, 64)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(res.sigma, s[:10], rtol=1e-10)
    assert np.all(np.diff(res.sigma) <= 0)
    assert np.allclose(res.V.T @ res.V, np.eye(10), atol=1e-10)
    row = svd.approximation_error(emb, "features", res.V).first()
    assert row["err"] == pytest.approx((x ** 2).sum() - (res.sigma ** 2).sum(), rel=1e-9)
    assert row["err"] <= row["fro_sq"]


def test_svd_full_rank_has_zero_error(emb):
    small = emb.select(F.slice("features", 1, 6).alias("features"))
    res = svd.truncated_svd(small, "features", 6, 6)
    assert svd.approximation_error(small, "features", res.V).first()["relative_error"] < 1e-12


def test_svd_rank_deficient_returns_fewer_factors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 4.0],), ([3.0, 6.0],), ([-1.0, -2.0],)],
                               "features array<double>")
    res = svd.truncated_svd(df, "features", 2, 2)
    assert res.sigma.size == 1


def test_subspace_iteration_matches_gram(emb):
    a = svd.truncated_svd(emb, "features", 3, 64)
    b = svd.truncated_svd(emb, "features", 3, 64, method="subspace")
    assert b.method == "subspace"
    assert np.allclose(a.sigma, b.sigma, rtol=1e-8)
    assert np.allclose(np.abs(a.V.T @ b.V), np.eye(3), atol=1e-5)


def test_gemm_assignment_equals_exact_rule():
    from rowmill.operators import blocks
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 40))
    c = rng.standard_normal((12, 40))
    c[5] = c[2]                      # duplicate centre: exact tie -> lower index
    x[:10] = (c[3] + c[7]) / 2       # equidistant points
    a1, d1 = blocks.nearest_center(x, c)
    a2, d2 = blocks._nearest_exact(x, c)
    assert np.array_equal(a1, a2) and np.array_equal(d1, d2)
    assert not np.any(a1 == 5)


def test_svd_matches_mllib_rowmatrix(spark, emb, emb_np):
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    _, _, x = emb_np
    mat = RowMatrix(spark.sparkContext.parallelize([Vectors.dense(r) for r in x], 4))
    ref = mat.computeSVD(5, computeU=False)
    ours = svd.truncated_svd(emb, "features", 5, 64)
    assert np.allclose(ours.sigma, ref.s.toArray(), rtol=1e-9)
    vref = ref.V.toArray()
    assert np.allclose(np.abs(ours.V.T @ vref), np.eye(5), atol=1e-6)


def test_kmeans_matches_mllib_lloyd(spark, emb, emb_np):
    from pyspark.mllib.clustering import KMeans, KMeansModel
    from pyspark.mllib.linalg import Vectors

    _, _, x = emb_np
    init = x[:4].copy()
    model = KMeans.train(spark.sparkContext.parallelize([Vectors.dense(r) for r in x], 4), 4,
                         maxIterations=6, initializationMode="random", epsilon=0.0,
                         initialModel=KMeansModel([Vectors.dense(c) for c in init]))
    ref = np.array([np.asarray(c) for c in model.clusterCenters])
    ours = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=6, init="given",
                             initial_centers=init, epsilon=0.0)
    assert np.allclose(ours.centers, ref, atol=1e-12)


def test_partition_count_does_not_change_kmeans_svd_nmi(emb):
    base_fit = kmeans.kmeans_fit(emb, "features", 5, 64, max_iter=6, order_by="id", epsilon=0.0)
    base_svd = svd.truncated_svd(emb, "features", 4, 64)
    lab = emb.select("id", "label", (F.col("id") % 7).alias("p"))
    base_nmi = nmi.nmi(lab, "label", "p").first()
    for parts in (1, 16, 700):          # 700 > rows per split: many empty partitions
        df = emb.repartition(parts)
        fit = kmeans.kmeans_fit(df, "features", 5, 64, max_iter=6, order_by="id", epsilon=0.0)
        assert np.allclose(fit.centers, base_fit.centers, atol=1e-12)
        assert fit.iterations == base_fit.iterations
        s = svd.truncated_svd(df, "features", 4, 64)
        assert np.allclose(s.sigma, base_svd.sigma, rtol=1e-12)
        assert np.allclose(s.V, base_svd.V, atol=1e-10)
        r = nmi.nmi(lab.repartition(parts), "label", "p").first()
        assert r["nmi_arithmetic"] == pytest.approx(base_nmi["nmi_arithmetic"], abs=1e-13)


def test_first_init_needs_an_order(emb):
    with pytest.raises(ValueError, match="order_by"):
        kmeans.kmeans_fit(emb, "features", 3, 64, init="first")


def test_subspace_vectors_accurate_when_iterations_run_out(emb):
    """Ten close singular values: the pass budget ends before the residual
    test passes; the returned vectors must still be that last pass's Ritz
    vectors."""
    a = svd.truncated_svd(emb, "features", 10, 64)
    for iters in (40, 100):
        b = svd.truncated_svd(emb, "features", 10, 64, method="subspace", iterations=iters)
        assert np.allclose(a.sigma, b.sigma, rtol=1e-8)
        err = np.abs(np.abs(np.sum(a.V * b.V, axis=0)) - 1).max()
        assert err < (1e-6 if iters == 40 else 1e-12)


def test_reconstruct_arrow_path(emb, emb_np):
    ids, _, x = emb_np
    res = svd.truncated_svd(emb, "features", 5, 64)
    got = {r["id"]: r["features_hat"] for r in svd.reconstruct(emb, "features", res.V, keep=["id"]).collect()}
    want = x @ res.V @ res.V.T
    assert np.allclose(np.array([got[i] for i in ids]), want, atol=1e-12)
