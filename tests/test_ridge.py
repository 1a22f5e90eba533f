"""Invariants of the CG solvers against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.operators import moments, ridge


def closed_form(x, y, gamma):
    n, d = x.shape
    return np.linalg.solve(x.T @ x + n * gamma * np.eye(d), x.T @ y)


@pytest.mark.parametrize("method", ["gram", "matrix_free"])
def test_cg_solves_normal_equations(lineitem, li_np, method):
    x, y = li_np
    res = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3, method=method)
    w = closed_form(x, y, 0.1)
    assert np.allclose(res.weights, w, rtol=1e-9)
    n = x.shape[0]
    resid = x.T @ y - (x.T @ x + n * 0.1 * np.eye(3)) @ res.weights
    assert np.linalg.norm(resid) / np.linalg.norm(x.T @ y) < 1e-8
    assert res.converged and res.iterations <= 4


def test_history_matches_explicit_objective(lineitem, li_np):
    x, y = li_np
    n = x.shape[0]
    res = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3, max_iter=2, rel_tol=None)
    # max_iter=2: iterations t = 0, 1 -> recorded t = 0 only
    assert [h[0] for h in res.history] == [0]
    full = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3)
    objs = [h[1] for h in full.history]
    assert all(a >= b - 1e-9 for a, b in zip(objs, objs[1:]))
    w = full.weights
    sse = ((x @ w - y) ** 2).sum()
    assert full.history[-1][2] == pytest.approx(sse / n, rel=1e-9)
    assert full.history[-1][1] == pytest.approx((sse + n * 0.1 * w @ w) / (2 * n), rel=1e-9)


def test_objective_and_gradient_ops(lineitem, li_np):
    x, y = li_np
    n = x.shape[0]
    w = np.array([1.0, 2.0, 3.0])
    row = ridge.ridge_objective(lineitem, "features", "label", w, 0.5).first()
    sse = ((x @ w - y) ** 2).sum()
    assert row["train_error"] == pytest.approx(sse / n, rel=1e-12)
    assert row["objective"] == pytest.approx((sse + n * 0.5 * w @ w) / (2 * n), rel=1e-12)
    out = ridge.ridge_gradient(lineitem, "features", "label", w, 0.5)
    g = {r["j"]: r["grad"] for r in out.collect()}
    assert out.first()["train_error"] == pytest.approx(sse / n, rel=1e-12)
    want = x.T @ (x @ w - y) + n * 0.5 * w
    assert np.allclose([g[j] for j in range(3)], want, rtol=1e-10)
    mse = ridge.linear_mse(lineitem, "features", "label", w).first()["mse"]
    assert mse == pytest.approx(sse / n, rel=1e-12)


def test_multitask_columns_equal_single_task(emb, emb_np):
    _, labels, xfull = emb_np
    df = emb.select("label", F.slice("features", 1, 5).alias("features"))
    x = xfull[:, :5]
    n = x.shape[0]
    y = np.stack([(labels == c).astype(float) for c in range(10)], axis=1)
    # default stop rule: sum_c r_c.r_c < 1e-8 (absolute)
    res = ridge.ridge_multitask_cg(df, "features", "label", 1e-3, 5, 10)
    r = x.T @ y - (x.T @ x + n * 1e-3 * np.eye(5)) @ res.weights
    assert (r * r).sum() < 1e-8
    assert res.history[-1][1] < 1e-8
    # tight tolerance: every column equals the single-output closed form
    tight = ridge.ridge_multitask_cg(df, "features", "label", 1e-3, 5, 10, tol=0.0, rel_tol=1e-14)
    for c in range(10):
        w = closed_form(x, y[:, c], 1e-3)
        assert np.allclose(tight.weights[:, c], w, rtol=1e-8, atol=1e-12)


def test_multitask_empty_class_stays_finite(emb):
    df = emb.select("label", F.slice("features", 1, 3).alias("features"))
    res = ridge.ridge_multitask_cg(df, "features", "label", 1e-3, 3, 12)  # classes 10, 11 empty
    assert np.isfinite(res.weights).all()
    assert np.all(res.weights[:, 10:] == 0.0)
    assert res.converged


def test_label_out_of_range_is_a_clear_error(emb):
    df = emb.select("label", F.slice("features", 1, 3).alias("features"))
    with pytest.raises(ValueError, match="out of range"):
        ridge.ridge_multitask_cg(df, "features", "label", 1e-3, 3, 5)


def test_sql_and_arrow_moments_agree(emb):
    a = moments.moments(emb, "features", 64, "label", 10, "class", method="arrow")
    small = emb.select("label", F.slice("features", 1, 8).alias("features"))
    b = moments.moments(small, "features", 8, "label", 10, "class", method="sql")
    c = moments.moments(small, "features", 8, "label", 10, "class", method="arrow")
    assert np.allclose(b.xx, c.xx) and np.allclose(b.xy, c.xy) and b.n == c.n
    assert np.allclose(a.xx[:8, :8], b.xx)


def test_partition_count_does_not_change_results(lineitem):
    base = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3).weights
    for parts in (1, 7, 64):
        for method in ("gram", "matrix_free"):
            w = ridge.ridge_cg(lineitem.repartition(parts), "features", "label", 0.1, 3,
                               method=method).weights
            assert np.allclose(w, base, rtol=1e-10)


def test_direct_and_shuffle_combine_agree(emb, monkeypatch):
    from rowmill.operators import blocks, kmeans
    a = moments.moments(emb.repartition(5), "features", 64, "label", 10, "class", method="arrow")
    ka = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=3, order_by="id")
    monkeypatch.setattr(blocks, "DIRECT_COMBINE_VALUES", 0)
    b = moments.moments(emb.repartition(5), "features", 64, "label", 10, "class", method="arrow")
    kb = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=3, order_by="id")
    assert np.allclose(a.xx, b.xx, atol=1e-12) and np.allclose(a.xy, b.xy) and a.n == b.n
    assert np.allclose(ka.centers, kb.centers, atol=1e-13)


def test_single_row_and_history_report(spark):
    df = spark.createDataFrame([(2.0, [1.0, 0.5])], "label double, features array<double>")
    res = ridge.ridge_cg(df, "features", "label", 0.1, 2)
    x, y = np.array([[1.0, 0.5]]), np.array([2.0])
    assert np.allclose(res.weights, closed_form(x, y, 0.1), rtol=1e-10)
    rep = ridge.history_report(spark, res)
    assert rep.columns == ["iter", "objective", "train_error", "elapsed_sec"]
    assert rep.count() == len(res.history)


def test_rfm_pipeline_with_durable_features(emb):
    from rowmill.plans import pipelines
    a = pipelines.rfm_classification(emb, 10, 6, 1e-3, 1.0)
    b = pipelines.rfm_classification(emb, 10, 6, 1e-3, 1.0, durable_features=True)
    assert np.allclose(a.result.weights, b.result.weights, atol=1e-12)
    assert a.errors.first()["errors"] == b.errors.first()["errors"]


def test_wide_scores_use_gemm_and_agree(emb, emb_np, monkeypatch):
    _, labels, x = emb_np
    W = np.random.default_rng(2).standard_normal((64, 10))
    a = ridge.misclassification(emb, "features", "label", W).first()
    pa_ = {r["id"]: r["prediction"] for r in ridge.predict_class(emb, "features", W, keep=["id"]).collect()}
    monkeypatch.setattr(ridge, "SCORE_EXPR_TERMS", 10)
    b = ridge.misclassification(emb, "features", "label", W).first()
    pb = {r["id"]: r["prediction"] for r in ridge.predict_class(emb, "features", W, keep=["id"]).collect()}
    want = int(np.count_nonzero(np.argmax(x @ W, axis=1) != labels))
    assert a["errors"] == b["errors"] == want and a["n"] == b["n"] == len(labels)
    assert pa_ == pb


def test_many_classes_take_arrow_moments(emb):
    df = emb.select("label", F.slice("features", 1, 16).alias("features"))
    res = ridge.ridge_multitask_cg(df, "features", "label", 1e-3, 16, 147)
    assert res.weights.shape == (16, 147) and np.all(res.weights[:, 10:] == 0.0)


def test_cross_check_with_spark_ml_linear_regression(lineitem):
    """Spark ML's LinearRegression minimises the same objective only with
    regParam = gamma * stddev_samp(label); a loose, independent check."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    gamma = 0.1
    ours = ridge.ridge_cg(lineitem, "features", "label", gamma, 3).weights
    sd = lineitem.agg(F.stddev_samp("label")).first()[0]
    vec = lineitem.select("label", array_to_vector("features").alias("v"))
    lr = LinearRegression(featuresCol="v", labelCol="label", fitIntercept=False,
                          standardization=False, elasticNetParam=0.0, regParam=gamma * sd,
                          maxIter=200, tol=1e-12).fit(vec)
    assert np.allclose(lr.coefficients.toArray(), ours, rtol=1e-4)


def test_iterative_fits_without_persisting(emb, lineitem):
    from rowmill.operators import kmeans, svd
    a = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3, method="matrix_free")
    b = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3, method="matrix_free", persist=False)
    assert np.allclose(a.weights, b.weights, rtol=1e-12)
    ka = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=4, order_by="id")
    kb = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=4, order_by="id", persist=False)
    assert np.allclose(ka.centers, kb.centers, atol=1e-12)
    sa = svd.truncated_svd(emb, "features", 3, 64, method="subspace")
    sb = svd.truncated_svd(emb, "features", 3, 64, method="subspace", persist=False)
    assert np.allclose(sa.sigma, sb.sigma, rtol=1e-10)


def test_vector_labels_equal_class_labels(emb):
    from rowmill.functions import vectors as V
    df = emb.select("label", V.one_hot("label", 10).alias("y"), F.slice("features", 1, 20).alias("features"))
    a = moments.moments(df, "features", 20, "label", 10, "class", method="arrow")
    b = moments.moments(df, "features", 20, "y", 10, "vector", method="arrow")
    assert np.allclose(a.xy, b.xy) and np.allclose(a.yy, b.yy) and np.allclose(a.xx, b.xx)
    ra = ridge.ridge_multitask_cg(df, "features", "label", 1e-3, 20, 10)
    rb = ridge.ridge_multitask_cg(df, "features", "y", 1e-3, 20, 10, label_kind="vector")
    assert np.allclose(ra.weights, rb.weights, atol=1e-12)
    ea = ridge.misclassification(df, "features", "label", ra.weights).first()
    eb = ridge.misclassification(df, "features", "y", rb.weights, label_kind="vector").first()
    assert ea["errors"] == eb["errors"]


def test_fits_reuse_and_keep_a_callers_persisted_frame(emb):
    from rowmill.operators import kmeans
    from rowmill.session import cached
    mine = cached(emb.select("id", "label", "features").repartition(3))
    mine.count()
    kmeans.kmeans_fit(mine, "features", 3, 64, max_iter=2, order_by="id")
    ridge.ridge_multitask_cg(mine, "features", "label", 1e-3, 64, 10, method="matrix_free", max_iter=3)
    assert mine.storageLevel.useMemory or mine.storageLevel.useDisk    # still the caller's
    mine.unpersist()


def test_coalesce_target_respects_dynamic_allocation():
    from rowmill.operators import blocks

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Ctx:
        def __init__(self, conf, par):
            self._c, self.defaultParallelism = Conf(conf), par

        def getConf(self):
            return self._c

    class Sess:
        def __init__(self, conf, par):
            self.sparkContext = Ctx(conf, par)

    assert blocks.coalesce_target(Sess({}, 8)) == 32
    dyn = {"spark.dynamicAllocation.enabled": "true"}
    assert blocks.coalesce_target(Sess(dyn, 2)) is None             # unbounded: never coalesce
    bounded = dict(dyn, **{"spark.dynamicAllocation.maxExecutors": "1000",
                           "spark.executor.cores": "8"})
    assert blocks.coalesce_target(Sess(bounded, 2)) == 32000        # not the 2 cores seen so far


def test_broadcast_shipping_path_gives_same_fits(emb, lineitem, monkeypatch):
    from rowmill.operators import blocks, kmeans
    a = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3, method="matrix_free").weights
    ka = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=4, order_by="id").centers
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)       # every model array as a broadcast
    b = ridge.ridge_cg(lineitem, "features", "label", 0.1, 3, method="matrix_free").weights
    kb = kmeans.kmeans_fit(emb, "features", 4, 64, max_iter=4, order_by="id").centers
    assert np.allclose(a, b, rtol=1e-12) and np.allclose(ka, kb, atol=1e-12)
