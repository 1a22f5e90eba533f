"""Fits on the whole 64-wide embedding rows and on 64 random features, with
oracles in DuckDB SQL.

Conjugate gradient is a recursive CTE over (iteration, output): the Gram table
is a list of rows, and each step is a handful of list products. Training errors
are summed over row residuals. SVD results are checked by the spectral moments
tr(G), tr(G²), tr(G³) of the Gram table (k = d) and by certificates that hold
for any correct rank-k result. The random-feature fits run to convergence; their
SQL takes more steps than that needs (``CLASS_STEPS``, ``REGRESSION_STEPS``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import exact, kmeans, moments, ridge, svd
from ..session import scratch_path
from ..sources import csv as csv_src
from . import oracle as O
from . import pipelines
from .queries import EMB_D, GAMMA_SCALED, K, MT_GAMMA, R, RFF_SIGMA, emb, li, register

GAMMA = 1e-3
STEPS = 8                     # iterations of both sides; neither has converged by then
RANK = 10
WIDE_S = 64                   # random features of the wide RFF queries
CLASS_STEPS, REGRESSION_STEPS = 64, 200

def _gram(points: str) -> str:
    """CTEs of the Gram table of ``points``, SQL of pts(vec_id, label, x)."""
    return f"""{points}, {O.emb_long()},
gram AS MATERIALIZED (
  SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS g FROM el a JOIN el b USING (vec_id) GROUP BY ALL),
gram_rows AS (SELECT i, list(g ORDER BY j) AS r FROM gram GROUP BY i),
gram_list AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM gram_rows)"""


_GRAM = _gram(O.EMB)


def _cg(targets: str, points: str = O.EMB, gamma: float = GAMMA, steps: int = STEPS, width: int = EMB_D) -> str:
    """CTEs of CG: cg(t, c, w, r, p) after t steps for each output c.

    ``targets``: SQL of (c, vec_id, y); ``width``: features of a point."""
    _LIST = f"range(1, {width + 1})"
    return f"""{_gram(points)}, targets AS ({targets}),
rhs AS (SELECT c, j, sum(v * y) AS s FROM el JOIN targets USING (vec_id) GROUP BY c, j),
start AS MATERIALIZED (
  SELECT c, list(s ORDER BY j) AS b, any_value(m) AS m, (SELECT count(*) FROM pts) * {O.lit(gamma)} AS ng
  FROM rhs, gram_list GROUP BY c),
cg AS (
  SELECT 0 AS t, c, [CAST(0 AS DOUBLE) for i in b] AS w, b AS r, b AS p FROM start
  UNION ALL
  SELECT t + 1, c, w, r, [r[i] + beta * p[i] for i in {_LIST}] FROM (
    SELECT t, c, w, r, p, list_dot_product(r, r) / rs AS beta FROM (
      SELECT t, c, p, rs, [w[i] + alpha * p[i] for i in {_LIST}] AS w,
             [r[i] - alpha * ap[i] for i in {_LIST}] AS r FROM (
        SELECT *, rs / list_dot_product(p, ap) AS alpha FROM (
          SELECT t, g.c, w, r, p, list_dot_product(r, r) AS rs,
                 [list_dot_product(m[i], p) + ng * p[i] for i in {_LIST}] AS ap
          FROM cg g JOIN start s ON s.c = g.c WHERE t < {steps})))))"""


_ONE = "SELECT 0 AS c, vec_id, CAST(label AS DOUBLE) AS y FROM pts"
_CLASSES = (f"SELECT k AS c, vec_id, CASE WHEN label = k THEN 1.0 ELSE 0.0 END AS y "
            f"FROM pts, range({K}) r(k)")
_FIT = f"""WITH RECURSIVE {_cg(_ONE)}
SELECT CAST(unnest(range({EMB_D})) AS BIGINT) AS j, round(unnest(w), 6) AS weight FROM cg WHERE t = {STEPS}"""
_HISTORY = f"""WITH RECURSIVE {_cg(_ONE)},
err AS (
  SELECT t, any_value(w) AS w, count(*) AS n, sum(pow(list_dot_product(x, w) - label, 2)) AS sse
  FROM pts, cg WHERE t % 2 = 1 GROUP BY t)
SELECT CAST(t - 1 AS INTEGER) AS iter,
       round((sse + n * {O.lit(GAMMA)} * list_dot_product(w, w)) / (2 * n), 8) AS objective,
       round(sse / n, 8) AS train_error FROM err"""


def _fit(spark, sf, method):
    return ridge.ridge_cg(emb(spark, sf), "features", "label", GAMMA, EMB_D, max_iter=STEPS, rel_tol=None,
                          method=method)


@register("ridge_cg_fit_wide", _FIT)
def q_fit(spark, sf):
    return ridge.weights_frame(spark, _fit(spark, sf, "gram").weights).select("j", R("weight", 6).alias("weight"))


@register("ridge_cg_matrix_free", _FIT)
def q_matrix_free(spark, sf):
    return ridge.weights_frame(spark, _fit(spark, sf, "matrix_free").weights).select(
        "j", R("weight", 6).alias("weight"))


@register("ridge_cg_history_wide", _HISTORY)
def q_history(spark, sf):
    return ridge.history_frame(spark, _fit(spark, sf, "gram").history).select(
        F.col("iter").cast("int").alias("iter"), R("objective", 8).alias("objective"),
        R("train_error", 8).alias("train_error"))


def _classes(spark, sf, method="gram"):
    return ridge.ridge_multitask_cg(emb(spark, sf), "features", "label", GAMMA, EMB_D, K, max_iter=STEPS,
                                    tol=0.0, rel_tol=None, method=method)


@register("ridge_multitask_fit_wide", f"""WITH RECURSIVE {_cg(_CLASSES)}
SELECT CAST(unnest(range({EMB_D})) AS BIGINT) AS j, c, round(unnest(w), 6) AS weight FROM cg WHERE t = {STEPS}""")
def q_multitask(spark, sf):
    return ridge.weights_frame(spark, _classes(spark, sf).weights).select("j", "c", R("weight", 6).alias("weight"))


@register("ridge_multitask_residuals", f"""WITH RECURSIVE {_cg(_CLASSES)},
scale AS (SELECT c, list_dot_product(b, b) AS s FROM start)
SELECT CAST(t - 1 AS BIGINT) AS iter, c, round(list_dot_product(r, r) / s, 9) AS relative_rs
FROM cg JOIN scale USING (c) WHERE t > 0""")
def q_residuals(spark, sf):
    """r_c·r_c of every output and iteration, over its start value."""
    e = emb(spark, sf)
    res = _classes(spark, sf, "matrix_free")
    start = moments.moments(e, "features", EMB_D, "label", K, "class").xy
    s = spark.createDataFrame([(c, float(v)) for c, v in enumerate((start * start).sum(axis=0))], "c long, s double")
    return ridge.residual_frame(spark, res).join(s, "c").select(
        "iter", "c", F.round(F.col("rs") / F.col("s"), 9).alias("relative_rs"))


@register("misclassification_wide", f"""WITH RECURSIVE {_cg(_CLASSES)},
scores AS (SELECT vec_id, label, c, list_dot_product(x, w) AS s FROM pts, cg WHERE t = {STEPS}),
best AS (SELECT vec_id, any_value(label) AS label, arg_max(c, s) AS prediction FROM scores GROUP BY vec_id)
SELECT count(*) FILTER (prediction <> label) AS errors, count(*) AS n,
       round(count(*) FILTER (prediction <> label) / count(*), 10) AS rate FROM best""")
def q_misclassification(spark, sf):
    out = ridge.misclassification(emb(spark, sf), "features", "label", _classes(spark, sf).weights)
    return out.select("errors", "n", R("rate", 10).alias("rate"))


_LINE = [math.sin(j + 1.0) for j in range(EMB_D)]          # a given linear model on the 64-wide rows


@register("exact_statistics", f"""WITH {O.EMB}, {O.emb_long()},
row_errors AS (SELECT pow(list_dot_product(x, {O.dlist(_LINE)}) - label, 2) AS e FROM pts)
SELECT round(avg(label), 10) AS label_mean, round((SELECT fsum(v * v) FROM el), 8) AS fro_sq,
       round((SELECT favg(e) FROM row_errors), 8) AS mse FROM pts""")
def q_exact(spark, sf):
    """Statistics over exact sums: the same bits for any partitioning of the rows."""
    e = emb(spark, sf)
    out = exact.label_mean(e).crossJoin(exact.frobenius_norm_sq(e, "features", EMB_D))       # one row each
    out = out.crossJoin(exact.linear_mse(e, "features", "label", _LINE))
    return out.select(R("label_mean", 10).alias("label_mean"), R("fro_sq", 8).alias("fro_sq"), R("mse", 8).alias("mse"))


@register("svd_spectral_moments", f"""WITH {_GRAM},
traces AS (
  SELECT (SELECT sum(g) FROM gram WHERE i = j) AS t1, (SELECT sum(g * g) FROM gram) AS t2,
         (SELECT sum(a.g * b.g * c.g) FROM gram a JOIN gram b ON b.i = a.j JOIN gram c ON c.i = b.j AND c.j = a.i) AS t3)
SELECT round(t1, 6) AS m1, round(t2 / (t1 * t1), 10) AS m2, round(t3 / (t1 * t1 * t1), 10) AS m3 FROM traces""")
def q_moments(spark, sf):
    """Σσ², Σσ⁴/(Σσ²)², Σσ⁶/(Σσ²)³ over all 64 singular values."""
    s = svd.truncated_svd(emb(spark, sf), "features", EMB_D, EMB_D).sigma ** 2
    t = float(s.sum())
    return spark.createDataFrame([(t, float((s ** 2).sum()) / t ** 2, float((s ** 3).sum()) / t ** 3)],
                                 "m1 double, m2 double, m3 double").select(
        R("m1", 6).alias("m1"), R("m2", 10).alias("m2"), R("m3", 10).alias("m3"))


_CERTIFICATE = f"""WITH {_GRAM}
SELECT CAST({RANK} AS BIGINT) AS rank, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS orthogonality, 0.0::DOUBLE AS error_gap,
       round(sum(g), 6) AS fro_sq FROM gram WHERE i = j"""


def _certificate(spark, sf, method):
    """Relative ‖A'A v - σ² v‖, ‖V'V - I‖ and the gap between the error summed
    over rows and ‖A‖² - Σσ²; all are 0 for a right result."""
    e = emb(spark, sf)
    res = svd.truncated_svd(e, "features", RANK, EMB_D, method=method)
    g = moments.moments(e, "features", EMB_D).xx
    lam = res.sigma ** 2
    row = svd.approximation_error(e, "features", res.V).first()
    resid = float(np.abs(g @ res.V - res.V * lam).max() / lam[0])
    ortho = float(np.abs(res.V.T @ res.V - np.eye(RANK)).max())
    gap = float(abs(row["err"] - (row["fro_sq"] - lam.sum())) / row["fro_sq"])
    return spark.createDataFrame([(len(lam), round(resid, 8) + 0.0, round(ortho, 8) + 0.0, round(gap, 8) + 0.0,
                                   float(row["fro_sq"]))],
                                 "rank long, residual double, orthogonality double, error_gap double, fro_sq double"
                                 ).withColumn("fro_sq", R("fro_sq", 6))


@register("svd_rank10_certificate", _CERTIFICATE)
def q_rank10(spark, sf):
    return _certificate(spark, sf, "gram")


@register("svd_subspace_rank10", _CERTIFICATE)
def q_subspace(spark, sf):
    return _certificate(spark, sf, "krylov")


@register("svd_tsqr_rank10", _CERTIFICATE)
def q_tsqr(spark, sf):
    return _certificate(spark, sf, "tsqr")


@register("kmeans_fit_parallel_init", f"""WITH {O.EMB}, {O.emb_long()}
SELECT j, round(sum(v), 6) AS sum_x, (SELECT count(*) FROM pts) AS n, CAST({K} AS BIGINT) AS k,
       CAST(0 AS BIGINT) AS not_nearest, true AS cost_bound FROM el GROUP BY j""")
def q_kmeans_parallel(spark, sf):
    """k-means with the default k-means‖ start, run to a fixed point: every
    centre is the mean of its rows, so Σ_c n_c·center_cj is the column sum;
    no row is nearer to another centre; the cost is at most 1.05 times that of
    the fit from the first k rows."""
    e = emb(spark, sf).withColumnRenamed("vec_id", "id").cache()
    fit = kmeans.kmeans_fit(e, "features", K, EMB_D, max_iter=100, init="k-means||", seed=7, epsilon=0.0)
    plain = kmeans.kmeans_fit(e, "features", K, EMB_D, max_iter=100, init="first", order_by="id", epsilon=0.0)
    near = kmeans.assign(e, "features", fit.centers, keep=["id"])
    sizes = {r["prediction"]: r["n"] for r in near.groupBy("prediction").agg(F.count("*").alias("n")).collect()}
    means = kmeans.kmeans_fit(e, "features", K, EMB_D, max_iter=1, init="given", initial_centers=fit.centers,
                              epsilon=0.0).centers
    after = kmeans.assign(e, "features", means, keep=["id"]).withColumnRenamed("prediction", "p2")
    moved = near.join(after.select("id", "p2"), "id").where("prediction <> p2").count()
    cost = [kmeans.cost(e, "features", c).first()["cost"] for c in (fit.centers, plain.centers)]
    total = sum(np.asarray(fit.centers)[c] * n for c, n in sizes.items())
    return spark.createDataFrame(
        [(j, float(v), sum(sizes.values()), len(fit.centers), moved, cost[0] <= 1.05 * cost[1]) for j, v in enumerate(total)],
        "j long, sum_x double, n long, k long, not_nearest long, cost_bound boolean").withColumn("sum_x", R("sum_x", 6))


# ---------------------------------------------------------------------------
# E2' / E3 / C9 on 64 random features
# ---------------------------------------------------------------------------

_Z, _V = feat.rff_params(EMB_D, WIDE_S, RFF_SIGMA)
_RFF = (O.EMB.replace("pts", "raw", 1) + f", pts AS MATERIALIZED (SELECT vec_id, label, [" + ", ".join(
    f"sqrt(2.0 / {WIDE_S}) * cos(list_dot_product(x, {O.dlist(_Z[i])}) + {O.lit(_V[i])})" for i in range(WIDE_S))
    + "] AS x FROM raw)")
_RFF_BEST = f"""WITH RECURSIVE {_cg(_CLASSES, _RFF, MT_GAMMA, CLASS_STEPS)},
scores AS (SELECT vec_id, label, c, list_dot_product(x, w) AS s FROM pts, cg WHERE t = {CLASS_STEPS}),
best AS (SELECT vec_id, any_value(label) AS label, arg_max(c, s) AS prediction FROM scores GROUP BY vec_id)"""
_RFF_ERRORS = _RFF_BEST + """
SELECT count(*) FILTER (prediction <> label) AS errors, count(*) AS n,
       round(count(*) FILTER (prediction <> label) / count(*), 10) AS rate FROM best"""


@register("pipeline_rfm_classification_wide", _RFF_ERRORS)
def q_rfm_class(spark, sf):
    run = pipelines.rfm_classification(emb(spark, sf), K, WIDE_S, MT_GAMMA, RFF_SIGMA, d=EMB_D)
    return run.errors.select("errors", "n", R("rate", 10).alias("rate"))


@register("pipeline_rfm_classification_csv_wide", _RFF_ERRORS)
def q_rfm_class_csv(spark, sf):
    path = scratch_path(spark, "e3-csv-wide")
    csv_src.write_labeled_csv(emb(spark, sf), path, EMB_D)
    run = pipelines.rfm_classification_csv(spark, path, K, WIDE_S, MT_GAMMA, RFF_SIGMA, num_features=EMB_D)
    return run.errors.select("errors", "n", R("rate", 10).alias("rate"))


@register("argmax_class_wide", _RFF_BEST + """
SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction FROM best""")
def q_argmax(spark, sf):
    mapped = feat.rbf_random_features(emb(spark, sf), "features", EMB_D, WIDE_S, RFF_SIGMA, keep=["vec_id", "label"])
    res = ridge.ridge_multitask_cg(mapped, "features", "label", MT_GAMMA, WIDE_S, K)
    out = ridge.predict_class(mapped, "features", res.weights, keep=["vec_id", "label"])
    return out.select("vec_id", F.col("label").cast("long"), F.col("prediction").cast("long"))


FUSED_S, FUSED_STEPS = 512, 8          # random features of the fused fit, and its iterations on both sides
_ZF, _VF = feat.rff_params(EMB_D, FUSED_S, RFF_SIGMA)


def _points(z: np.ndarray, v: np.ndarray) -> str:
    """CTEs of pts(vec_id, label, x) with x the random features, Z as a list of rows."""
    s = len(v)
    rows = ", ".join(O.dlist(z[i]) for i in range(s))
    return (O.EMB.replace("pts", "raw", 1) + f", zs AS MATERIALIZED (SELECT [{rows}] AS z, {O.dlist(v)} AS v), "
            f"pts AS MATERIALIZED (SELECT vec_id, label, [sqrt(2.0 / {s}) * cos(list_dot_product(x, z[i]) + v[i]) "
            f"for i in range(1, {s + 1})] AS x FROM raw, zs)")


@register("pipeline_rfm_classification_fused", f"""WITH RECURSIVE {_cg(_CLASSES, _points(_ZF, _VF), MT_GAMMA, FUSED_STEPS, FUSED_S)},
scores AS (SELECT vec_id, label, c, list_dot_product(x, w) AS s FROM pts, cg WHERE t = {FUSED_STEPS}),
best AS (SELECT vec_id, any_value(label) AS label, arg_max(c, s) AS prediction FROM scores GROUP BY vec_id)
SELECT count(*) FILTER (prediction <> label) AS errors, count(*) AS n,
       (SELECT round(sum(list_dot_product(w, w)), 2) FROM cg WHERE t = {FUSED_STEPS}) AS weights_sq FROM best""")
def q_rfm_fused(spark, sf):
    """E3 on 512 features, matrix-free: every pass maps the 64-wide rows itself,
    no mapped row is stored."""
    run = pipelines.rfm_classification(emb(spark, sf), K, FUSED_S, MT_GAMMA, RFF_SIGMA, d=EMB_D, max_iter=FUSED_STEPS,
                                       rel_tol=None, method="matrix_free")
    return run.errors.select("errors", "n", F.round(F.lit(float((run.result.weights ** 2).sum())), 2).alias("weights_sq"))


_Z3, _V3 = feat.rff_params(3, WIDE_S, 1.0)         # Z for sigma = 1; divided by the estimate below
_RFF_LI = (O.li_scaled() + ", bw AS (SELECT sqrt(2 * (var_pop(x0) + var_pop(x1) + var_pop(x2))) AS sg FROM lis), "
           "pts AS MATERIALIZED (SELECT row_number() OVER () AS vec_id, y AS label, [" + ", ".join(
               f"sqrt(2.0 / {WIDE_S}) * cos("
               + " + ".join(f"x{j} * ({O.lit(_Z3[i, j])} / sg)" for j in range(3)) + f" + {O.lit(_V3[i])})"
               for i in range(WIDE_S)) + "] AS x FROM lis, bw)")


@register("pipeline_rfm_regression_wide", f"""WITH RECURSIVE {_cg(_ONE, _RFF_LI, GAMMA_SCALED, REGRESSION_STEPS)},
fit AS (SELECT w FROM cg WHERE t = {REGRESSION_STEPS}),
err AS (SELECT avg(pow(list_dot_product(x, w) - label, 2)) AS mse FROM pts, fit)
SELECT CAST(unnest(range({WIDE_S})) AS BIGINT) AS j, round(unnest(w), 4) AS weight,
       round((mse + {O.lit(GAMMA_SCALED)} * list_dot_product(w, w)) / 2, 6) AS objective,
       round(mse, 6) AS train_error FROM fit, err""")
def q_rfm_regression(spark, sf):
    """Weights with the last objective and training error."""
    run = pipelines.rfm_regression(li(spark, sf), GAMMA_SCALED, WIDE_S, rel_tol=1e-13, d=3)
    _, objective, error = run.result.history[-1]
    return run.weights.select("j", R("weight", 4).alias("weight"), F.round(F.lit(objective), 6).alias("objective"),
                              F.round(F.lit(error), 6).alias("train_error"))
