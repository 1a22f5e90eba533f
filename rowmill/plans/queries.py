"""Registered queries: one per operator of the inventory, each reading the
whole driver tables under ``sf_dir`` and returning a DataFrame, paired with
an equivalent DuckDB SQL (``ORACLES``) where one exists.

Conventions shared with the SQL: integer outputs are BIGINT, computed reals
are rounded to a fixed number of decimals, and every computed column is
aliased identically on both sides. The decimals are chosen so that the
expected difference between the two engines' summation orders is below
1e-7 of the rounding step: a value is checked to 7-10 significant digits,
and the chance that any of a query's values straddles a rounding boundary
stays negligible even for the many-row outputs. Values both engines compute
bit for bit (casts, exact divisions, integer sums) are not rounded.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import features as feat
from ..operators import kmeans, moments, nmi, ridge, stats, svd
from ..session import scratch_path, ship_package
from ..sources import csv as csv_src
from ..sources import array_files, libsvm, matrix
from . import oracle as O
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed parameters of the registered queries.
EMB_D = 64            # embedding length (property of the table)
SPARSE_D = 16         # sparse rows: index l_suppkey % 16
SKETCH_S = 8          # count-sketch width
RFF_S = 8             # random Fourier features on embeddings
RFF_SIGMA = 1.0
W_LIN = [1.5, 6.4, 5.0]           # a given linear model on lineitem
GAMMA_RAW = 0.1                   # ridge on raw lineitem features
GAMMA_SCALED = 1e-5               # ridge on centred / max-abs scaled lineitem
MT_GAMMA = 1e-3                   # multi-output ridge on embeddings
K = 10                            # clusters / classes on embeddings
KM_ITERS = 20
P_VEC = [1.0 / (j + 1) for j in range(EMB_D)]
E3_S = 3                          # RFF width of the classification pipeline
E2R_S = 3                         # RFF width of the RFF regression pipeline


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf):
            ship_package(spark)              # Arrow kernels import this package on the executors
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def R(col, digits: int):
    return F.round(col, digits)


# ---------------------------------------------------------------------------
# table readers (only the needed columns reach the scan)
# ---------------------------------------------------------------------------

def emb(spark, sf) -> DataFrame:
    """(vec_id, label, features array<double>) from embeddings."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def li(spark, sf) -> DataFrame:
    """lineitem as (features [quantity, discount, tax], label price/1000)."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber",
        F.array("l_quantity", "l_discount", "l_tax").alias("features"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("label"))


def part2(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(
        "p_partkey", F.array(F.col("p_size").cast("double"),
                             F.col("p_retailprice") / F.lit(100.0)).alias("features"))


def sparse_rows(spark, sf, d: int = SPARSE_D) -> DataFrame:
    """Per order a sparse row: index l_suppkey % d, value sum(l_quantity).

    Two-level aggregation: entries are first summed per (order, index)
    (partial aggregation map-side), then gathered per order. A group holds
    at most d entries however many lineitem rows an order has. (One
    groupBy(order) with d conditional sums saves the second shuffle but
    evaluates d conditions per input row; measured slower already at d=16.)"""
    entries = (spark.read.parquet(f"{sf}/lineitem.parquet")
               .groupBy(F.col("l_orderkey").alias("id"),
                        (F.col("l_suppkey") % d).cast("int").alias("j"))
               .agg(F.sum("l_quantity").alias("x")))
    return entries.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("features"))


def _long(df: DataFrame, id_col: str, arr: str, j: str = "j", v: str = "x",
          digits: int | None = None) -> DataFrame:
    out = df.select(F.col(id_col), F.posexplode(arr).alias(j, v))
    val = R(F.col(v), digits) if digits is not None else F.col(v)
    return out.select(F.col(id_col), F.col(j).cast("long").alias(j), val.alias(v))


# ---------------------------------------------------------------------------
# Matrix scan and norms
# ---------------------------------------------------------------------------

@register("matrix_dims", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(len(embedding)) AS BIGINT) AS d_min,
       CAST(max(len(embedding)) AS BIGINT) AS d_max FROM embeddings""")
def q_matrix_dims(spark, sf):
    return stats.dims(emb(spark, sf))


@register("frobenius_norm_sq", f"""
WITH {O.EMB} SELECT round(sum(list_sum(list_transform(x, lambda v: v * v))), 8) AS fro_sq FROM pts""")
def q_frobenius(spark, sf):
    return stats.frobenius_norm_sq(emb(spark, sf), d=EMB_D).select(R("fro_sq", 8).alias("fro_sq"))


@register("row_norm_sq", f"""
WITH {O.EMB} SELECT vec_id, round(list_sum(list_transform(x, lambda v: v * v)), 8) AS norm_sq FROM pts""")
def q_row_norm_sq(spark, sf):
    out = stats.row_norm_sq(emb(spark, sf), d=EMB_D, keep=["vec_id"])
    return out.select("vec_id", R("norm_sq", 8).alias("norm_sq"))


@register("matrix_scan", f"""
WITH {O.EMB}, {O.emb_long()} SELECT vec_id, j, v AS x FROM el""")
def q_matrix_scan(spark, sf):
    m = matrix.read_matrix(spark, f"{sf}/embeddings.parquet", "embedding", "vec_id")
    return matrix.to_long(m).withColumnRenamed("id", "vec_id")


@register("matrix_head_subset", f"""
WITH {O.EMB}, h AS (SELECT * FROM pts ORDER BY vec_id LIMIT 200),
el AS (SELECT vec_id, CAST(unnest(range(len(x))) AS BIGINT) AS j, unnest(x) AS v FROM h)
SELECT vec_id, j, v AS x FROM el""")
def q_head_subset(spark, sf):
    m = matrix.read_matrix(spark, f"{sf}/embeddings.parquet", "embedding", "vec_id")
    return matrix.to_long(matrix.head_rows(m, 200, "id")).withColumnRenamed("id", "vec_id")


@register("matrix_preview", f"""
WITH {O.EMB}, h AS (SELECT vec_id, x[1:10] AS x FROM pts ORDER BY vec_id LIMIT 101),
el AS (SELECT vec_id, CAST(unnest(range(len(x))) AS BIGINT) AS j, unnest(x) AS v FROM h)
SELECT vec_id, j, v AS x FROM el""")
def q_preview(spark, sf):
    m = matrix.read_matrix(spark, f"{sf}/embeddings.parquet", "embedding", "vec_id")
    return matrix.to_long(matrix.preview(m, 101, 10, "id")).withColumnRenamed("id", "vec_id")


@register("matrix_csv_roundtrip", f"""
WITH {O.EMB}, {O.emb_long()} SELECT vec_id, j, v AS x FROM el""")
def q_csv_roundtrip(spark, sf):
    m = matrix.read_matrix(spark, f"{sf}/embeddings.parquet", "embedding", "vec_id")
    path = scratch_path(spark, "matrix-csv")
    matrix.write_matrix_csv(m, path, EMB_D)
    back = matrix.read_matrix_csv(spark, path, EMB_D)
    return matrix.to_long(back).withColumnRenamed("id", "vec_id")


@register("partition_control", f"""
WITH {O.LI} SELECT l_orderkey, l_linenumber, x0, x1, x2, y AS label FROM li""")
def q_partition_control(spark, sf):
    rows = li(spark, sf)
    n = rows.rdd.getNumPartitions()                    # counts follow the input
    df = matrix.partition_control(rows, 2 * n, coalesce=False)
    df = matrix.partition_control(df, n, coalesce=True)
    return df.select("l_orderkey", "l_linenumber", F.col("features")[0].alias("x0"),
                     F.col("features")[1].alias("x1"), F.col("features")[2].alias("x2"), "label")


# ---------------------------------------------------------------------------
# Casts, scaling, encoding
# ---------------------------------------------------------------------------

@register("label_cast", """
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS VARCHAR) AS txt FROM lineitem)
SELECT l_orderkey, l_linenumber,
       CAST(trunc(CAST(txt AS FLOAT)) AS BIGINT) AS label_int,
       CAST(CAST(txt AS FLOAT) AS DOUBLE) AS label_float,
       CAST(txt AS DOUBLE) AS label_double FROM t""")
def q_label_cast(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("string").alias("txt"))
    return t.select("l_orderkey", "l_linenumber",
                    V.label_cast("txt", "int").cast("long").alias("label_int"),
                    V.label_cast("txt", "double").alias("label_float"),
                    V.label_cast("txt", "double", via_float=False).alias("label_double"))


@register("label_mean", f"WITH {O.LI} SELECT round(avg(y), 9) AS label_mean FROM li")
def q_label_mean(spark, sf):
    return stats.label_mean(li(spark, sf)).select(R("label_mean", 9).alias("label_mean"))


@register("feature_max_abs", f"""
WITH {O.LI} SELECT CAST(0 AS BIGINT) AS j, max(abs(x0)) AS max_abs FROM li
UNION ALL SELECT 1, max(abs(x1)) FROM li UNION ALL SELECT 2, max(abs(x2)) FROM li""")
def q_feature_max_abs(spark, sf):
    return stats.feature_max_abs(li(spark, sf), d=3)


@register("center_maxabs_scale", f"""
WITH {O.li_scaled()} SELECT round(y, 6) AS label, round(x0, 9) AS f0, round(x1, 9) AS f1,
round(x2, 9) AS f2 FROM lis""")
def q_center_scale(spark, sf):
    out, _ = stats.center_maxabs_scale(li(spark, sf), "label", "features", 3)
    return out.select(R("label", 6).alias("label"),
                      *[R(F.col("features")[j], 9).alias(f"f{j}") for j in range(3)])


@register("one_hot_encode", f"""
SELECT vec_id, CAST(c AS BIGINT) AS c, CAST(CASE WHEN label = c THEN 1 ELSE 0 END AS DOUBLE) AS y
FROM embeddings, range({K}) r(c)""")
def q_one_hot(spark, sf):
    e = emb(spark, sf).select("vec_id", V.one_hot("label", K).alias("y"))
    return _long(e, "vec_id", "y", "c", "y")


@register("densify_sparse", f"""
WITH {O.sparse(SPARSE_D)}, ids AS (SELECT DISTINCT id FROM sp)
SELECT ids.id, CAST(r.j AS BIGINT) AS j, coalesce(sp.x, 0.0) AS x
FROM ids CROSS JOIN range({SPARSE_D}) r(j) LEFT JOIN sp ON sp.id = ids.id AND sp.j = r.j""")
def q_densify(spark, sf):
    rows = sparse_rows(spark, sf).select("id", V.densify_map("features", SPARSE_D).alias("dense"))
    return _long(rows, "id", "dense")


# ---------------------------------------------------------------------------
# kernels
# ---------------------------------------------------------------------------

def _rff_values_sql(z: np.ndarray, v: np.ndarray) -> str:
    rows = ", ".join(f"({i}, {O.dlist(z[i])}, {float(v[i])!r})" for i in range(z.shape[0]))
    return f"zt(i, z, v) AS (SELECT * FROM (VALUES {rows}))"


_Z8, _V8 = feat.rff_params(EMB_D, RFF_S, RFF_SIGMA)


@register("rbf_random_features", f"""
WITH {O.EMB}, {_rff_values_sql(_Z8, _V8)}
SELECT vec_id, CAST(i AS BIGINT) AS i,
       round(sqrt(2.0 / {RFF_S}) * cos(list_dot_product(z, x) + v), 7) AS phi
FROM pts, zt""")
def q_rff(spark, sf):
    m = feat.rbf_random_features(emb(spark, sf), "features", EMB_D, RFF_S, RFF_SIGMA,
                                 keep=["vec_id"], out="phi")
    return _long(m, "vec_id", "phi", "i", "phi", digits=7)


_H, _SG = feat.sketch_params(SPARSE_D, SKETCH_S)


@register("count_sketch_features", f"""
WITH {O.sparse(SPARSE_D)},
hs(j, h, sg) AS (SELECT * FROM (VALUES {', '.join(f'({j}, {int(_H[j])}, {float(_SG[j])!r})' for j in range(SPARSE_D))})),
b AS (SELECT sp.id, hs.h, sum(sp.x * hs.sg) AS x FROM sp JOIN hs ON sp.j = hs.j GROUP BY sp.id, hs.h),
ids AS (SELECT DISTINCT id FROM sp)
SELECT ids.id, CAST(r.i AS BIGINT) AS i, coalesce(b.x, 0.0) AS value
FROM ids CROSS JOIN range({SKETCH_S}) r(i) LEFT JOIN b ON b.id = ids.id AND b.h = r.i""")
def q_count_sketch(spark, sf):
    rows = feat.count_sketch(sparse_rows(spark, sf), "features", SPARSE_D, SKETCH_S,
                             keep=["id"], out="value")
    return _long(rows, "id", "value", "i", "value")


@register("rbf_bandwidth", f"""
WITH {O.EMB}, {O.emb_long()}, vp AS (SELECT j, var_pop(v) AS s FROM el GROUP BY j)
SELECT round(2 * sum(s), 10) AS sigma_sq, round(sqrt(2 * sum(s)), 10) AS sigma FROM vp""")
def q_bandwidth(spark, sf):
    return stats.rbf_bandwidth(emb(spark, sf), d=EMB_D).select(
        R("sigma_sq", 10).alias("sigma_sq"), R("sigma", 10).alias("sigma"))


# ---------------------------------------------------------------------------
# moments
# ---------------------------------------------------------------------------

@register("cross_moment", f"""
WITH {O.LI} SELECT CAST(0 AS BIGINT) AS j, round(sum(x0 * y), 3) AS xy FROM li
UNION ALL SELECT 1, round(sum(x1 * y), 3) FROM li UNION ALL SELECT 2, round(sum(x2 * y), 3) FROM li""")
def q_cross_moment(spark, sf):
    out = moments.cross_moment(li(spark, sf), "features", "label", 3)
    return out.select("j", R("xy", 3).alias("xy"))


@register("gram_matrix", f"""
WITH {O.EMB}, {O.emb_long()}
SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 7) AS g
FROM el a JOIN el b ON a.vec_id = b.vec_id GROUP BY a.j, b.j""")
def q_gram(spark, sf):
    out = moments.gram_matrix(emb(spark, sf), "features", EMB_D)
    return out.select("i", "j", R("g", 7).alias("g"))


@register("gram_vector_product", f"""
WITH {O.EMB}, s AS (SELECT x, list_dot_product(x, {O.dlist(P_VEC)}) AS s FROM pts),
el AS (SELECT CAST(unnest(range(len(x))) AS BIGINT) AS j, unnest(x) AS v, s FROM s)
SELECT j, round(sum(v * s), 7) AS v FROM el GROUP BY j""")
def q_gram_vector(spark, sf):
    out = moments.gram_vector_product(emb(spark, sf), "features", EMB_D, P_VEC)
    return out.select("j", R("v", 7).alias("v"))


# ---------------------------------------------------------------------------
# Linear models and ridge CG
# ---------------------------------------------------------------------------

_WL = [O.lit(w) for w in W_LIN]
_SCORE_SQL = f"(x0 * {_WL[0]} + x1 * {_WL[1]} + x2 * {_WL[2]})"


@register("linear_score", f"""
WITH {O.LI} SELECT l_orderkey, l_linenumber, round({_SCORE_SQL}, 7) AS score FROM li""")
def q_linear_score(spark, sf):
    out = ridge.linear_score(li(spark, sf), "features", W_LIN, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", R("score", 7).alias("score"))


@register("ridge_objective", f"""
WITH {O.LI}, s AS (SELECT count(*) AS n, sum(({_SCORE_SQL} - y) * ({_SCORE_SQL} - y)) AS sse FROM li)
SELECT round(sse / n, 8) AS train_error,
       round((sse + n * {O.lit(GAMMA_RAW * float(np.dot(W_LIN, W_LIN)))}) / (2 * n), 8) AS objective FROM s""")
def q_ridge_objective(spark, sf):
    out = ridge.ridge_objective(li(spark, sf), "features", "label", W_LIN, GAMMA_RAW)
    return out.select(R("train_error", 8).alias("train_error"), R("objective", 8).alias("objective"))


@register("ridge_gradient", f"""
WITH {O.LI}, s AS (SELECT count(*) AS n, sum(x0 * ({_SCORE_SQL} - y)) AS g0,
  sum(x1 * ({_SCORE_SQL} - y)) AS g1, sum(x2 * ({_SCORE_SQL} - y)) AS g2,
  sum(({_SCORE_SQL} - y) * ({_SCORE_SQL} - y)) AS sse FROM li),
g AS (SELECT CAST(0 AS BIGINT) AS j, round(g0 + n * {O.lit(GAMMA_RAW * W_LIN[0])}, 3) AS grad FROM s
UNION ALL SELECT 1, round(g1 + n * {O.lit(GAMMA_RAW * W_LIN[1])}, 3) FROM s
UNION ALL SELECT 2, round(g2 + n * {O.lit(GAMMA_RAW * W_LIN[2])}, 3) FROM s)
SELECT j, grad, round(sse / n, 8) AS train_error,
  round((sse + n * {O.lit(GAMMA_RAW * sum(v * v for v in W_LIN))}) / (2 * n), 8) AS objective FROM g, s""")
def q_ridge_gradient(spark, sf):
    out = ridge.ridge_gradient(li(spark, sf), "features", "label", W_LIN, GAMMA_RAW)
    return out.select("j", R("grad", 3).alias("grad"), R("train_error", 8).alias("train_error"),
                      R("objective", 8).alias("objective"))


@register("linear_mse", f"""
WITH {O.LI} SELECT round(avg(({_SCORE_SQL} - y) * ({_SCORE_SQL} - y)), 8) AS mse FROM li""")
def q_linear_mse(spark, sf):
    return ridge.linear_mse(li(spark, sf), "features", "label", W_LIN).select(R("mse", 8).alias("mse"))


def _ridge_fit_sql(src_ctes: str, src: str, gamma: float, digits: int) -> str:
    w = O.solve3_exprs(f"n * {O.lit(gamma)}", [f"b_y_{i}" for i in range(3)])
    rows = " UNION ALL ".join(
        f"SELECT CAST({j} AS BIGINT) AS j, round({w[j]}, {digits}) AS weight FROM mom" for j in range(3))
    return f"WITH {src_ctes}, {O.moment_cols(src, ['x0', 'x1', 'x2'], {'y': 'y'})} {rows}"


@register("ridge_cg_fit", _ridge_fit_sql(O.LI, "li", GAMMA_RAW, 8))
def q_ridge_fit(spark, sf):
    res = ridge.ridge_cg(li(spark, sf), "features", "label", GAMMA_RAW, 3)
    return ridge.weights_frame(spark, res.weights).select("j", R("weight", 8).alias("weight"))


@register("ridge_cg_history", O.cg_history_sql(O.LI, "li", GAMMA_RAW, 4))
def q_ridge_history(spark, sf):
    res = ridge.ridge_cg(li(spark, sf), "features", "label", GAMMA_RAW, 3)
    h = ridge.history_frame(spark, res.history)
    return h.select("iter", R("objective", 4).alias("objective"), R("train_error", 4).alias("train_error"))


@register("pipeline_ridge_regression", O.cg_history_sql(O.li_scaled(), "lis", GAMMA_SCALED, 6))
def q_pipeline_ridge(spark, sf):
    run = pipelines.ridge_regression(li(spark, sf), GAMMA_SCALED, d=3)
    return run.history.select("iter", R("objective", 6).alias("objective"),
                              R("train_error", 6).alias("train_error"))


# ---------------------------------------------------------------------------
# Multi-output ridge on embeddings
# ---------------------------------------------------------------------------

MT_SIGMA = 2.0   # bandwidth of the 3 random features the multi-output queries fit on


def emb3(spark, sf) -> DataFrame:
    """embeddings mapped to 3 random Fourier features of the whole
    64-dimensional row (the 3 x 3 normal equations keep a closed-form
    SQL check while every component of every row is used)."""
    return feat.rbf_random_features(emb(spark, sf), "features", EMB_D, 3, MT_SIGMA,
                                    keep=["vec_id", "label"])


def _rff3_sql(sigma: float) -> str:
    z, v = feat.rff_params(EMB_D, 3, sigma)
    cols = ", ".join(
        f"sqrt(2.0 / 3) * cos(list_dot_product(x, {O.dlist(z[i])}) + {O.lit(v[i])}) AS x{i}"
        for i in range(3))
    return f"e3 AS (SELECT vec_id, label, {cols} FROM pts)"


_EMB3 = O.EMB + ", " + _rff3_sql(MT_SIGMA)


def _mt_ctes(src_ctes: str, src: str, gamma: float) -> str:
    ys = {f"c{c}": f"CASE WHEN label = {c} THEN 1.0 ELSE 0.0 END" for c in range(K)}
    mom = O.moment_cols(src, ["x0", "x1", "x2"], ys)
    ws = []
    for c in range(K):
        w = O.solve3_exprs(f"n * {O.lit(gamma)}", [f"b_c{c}_{i}" for i in range(3)])
        ws += [f"{w[i]} AS w{i}_{c}" for i in range(3)]
    return f"{src_ctes}, {mom}, wm AS (SELECT {', '.join(ws)} FROM mom)"


def _mt_scores(src: str) -> str:
    scores = ", ".join(f"x0 * w0_{c} + x1 * w1_{c} + x2 * w2_{c}" for c in range(K))
    return (f"sc AS (SELECT vec_id, label, [{scores}] AS s FROM {src}, wm), "
            f"pr AS (SELECT vec_id, label, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS prediction FROM sc)")


@register("ridge_multitask_fit", f"""
WITH {_mt_ctes(_EMB3, 'e3', MT_GAMMA)}
{' UNION ALL '.join(f'SELECT CAST({j} AS BIGINT) AS j, CAST({c} AS BIGINT) AS c, round(w{j}_{c}, 8) AS weight FROM wm' for j in range(3) for c in range(K))}""")
def q_mt_fit(spark, sf):
    res = ridge.ridge_multitask_cg(emb3(spark, sf), "features", "label", MT_GAMMA, 3, K)
    return ridge.weights_frame(spark, res.weights).select("j", "c", R("weight", 8).alias("weight"))


@register("ridge_multitask_history", O.multitask_history_sql(
    _EMB3, "e3", {f"c{c}": f"CASE WHEN label = {c} THEN 1.0 ELSE 0.0 END" for c in range(K)},
    MT_GAMMA, iters=3, digits=12))
def q_mt_history(spark, sf):
    res = ridge.ridge_multitask_cg(emb3(spark, sf), "features", "label", MT_GAMMA, 3, K)
    h = ridge.history_frame(spark, res.history, multi=True)
    return h.select("iter", R("residual_sq", 12).alias("residual_sq"))


@register("argmax_class", f"""
WITH {_mt_ctes(_EMB3, 'e3', MT_GAMMA)}, {_mt_scores('e3')}
SELECT vec_id, CAST(label AS BIGINT) AS label, prediction FROM pr""")
def q_argmax(spark, sf):
    res = ridge.ridge_multitask_cg(emb3(spark, sf), "features", "label", MT_GAMMA, 3, K)
    out = ridge.predict_class(emb3(spark, sf), "features", res.weights, keep=["vec_id", "label"])
    return out.select("vec_id", F.col("label").cast("long"), F.col("prediction").cast("long"))


@register("misclassification", f"""
WITH {_mt_ctes(_EMB3, 'e3', MT_GAMMA)}, {_mt_scores('e3')}
SELECT CAST(sum(CASE WHEN prediction <> label THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       CAST(count(*) AS BIGINT) AS n,
       round(sum(CASE WHEN prediction <> label THEN 1 ELSE 0 END) / count(*), 10) AS rate FROM pr""")
def q_misclassification(spark, sf):
    res = ridge.ridge_multitask_cg(emb3(spark, sf), "features", "label", MT_GAMMA, 3, K)
    out = ridge.misclassification(emb3(spark, sf), "features", "label", res.weights)
    return out.select("errors", "n", R("rate", 10).alias("rate"))


# ---------------------------------------------------------------------------
# K-means and NMI
# ---------------------------------------------------------------------------

def _kmeans(spark, sf):
    e = emb(spark, sf).withColumnRenamed("vec_id", "id")
    return e, kmeans.kmeans_fit(e, "features", K, EMB_D, max_iter=KM_ITERS, init="first",
                                order_by="id", epsilon=0.0)


_KM = O.kmeans_ctes(K, KM_ITERS)
_A = f"a{KM_ITERS + 1}"
_C = f"c{KM_ITERS}"


@register("kmeans_centers", f"""
WITH {_KM}, cl AS (SELECT cluster, CAST(unnest(range(len(center))) AS BIGINT) AS j,
                          unnest(center) AS v FROM {_C})
SELECT cluster, j, round(v, 8) AS center FROM cl""")
def q_kmeans_centers(spark, sf):
    _, fit = _kmeans(spark, sf)
    return kmeans.centers_frame(spark, fit.centers).select("cluster", "j", R("center", 8).alias("center"))


@register("kmeans_assign", f"""
WITH {_KM} SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction FROM {_A}""")
def q_kmeans_assign(spark, sf):
    e, fit = _kmeans(spark, sf)
    out = kmeans.assign(e, "features", fit.centers, keep=["id", "label"])
    return out.select(F.col("id").alias("vec_id"), F.col("label").cast("long"),
                      F.col("prediction").cast("long"))


@register("kmeans_cost", f"WITH {_KM} SELECT round(sum(dist), 8) AS cost FROM {_A}")
def q_kmeans_cost(spark, sf):
    e, fit = _kmeans(spark, sf)
    return kmeans.cost(e, "features", fit.centers).select(R("cost", 8).alias("cost"))


def _nmi_cols(df: DataFrame) -> DataFrame:
    return df.select(*[R(c, 10).alias(c) for c in
                       ("mi", "h_u", "h_v", "nmi_geometric", "nmi_arithmetic")])


@register("nmi_score", O.nmi_sql("", "labels", "quality", "toxic"))
def q_nmi(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    return _nmi_cols(nmi.nmi(lab, "quality", "toxic"))


@register("pipeline_kmeans_nmi", O.nmi_sql(_KM, _A, "label", "prediction"))
def q_pipeline_kmeans(spark, sf):
    e = emb(spark, sf).withColumnRenamed("vec_id", "id")
    run = pipelines.kmeans_nmi(e, K, max_iter=KM_ITERS, init="first", order_by="id", epsilon=0.0,
                               d=EMB_D)
    return _nmi_cols(run.score)


@register("label_pred_roundtrip", """
SELECT CAST(quality AS INTEGER) AS label, CAST(toxic AS INTEGER) AS prediction FROM labels""")
def q_label_pred(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    path = scratch_path(spark, "label-pred")
    matrix.write_label_pred(lab, path, "quality", "toxic")
    return matrix.read_label_pred(spark, path)


# ---------------------------------------------------------------------------
# Truncated SVD on part [p_size, p_retailprice/100]
# ---------------------------------------------------------------------------

def _svd(spark, sf, k):
    return svd.truncated_svd(part2(spark, sf), "features", k, 2)


@register("svd_singular_values", f"""
WITH {O.SVD2} SELECT CAST(0 AS BIGINT) AS k_idx, round(s1, 6) AS sigma FROM v
UNION ALL SELECT 1, round(s2, 6) FROM v""")
def q_svd_sigma(spark, sf):
    return svd.singular_values_frame(spark, _svd(spark, sf, 2)).select(
        "k_idx", R("sigma", 6).alias("sigma"))


@register("svd_right_vectors", f"""
WITH {O.SVD2}
SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS k_idx, round(v00, 9) AS v FROM v
UNION ALL SELECT 1, 0, round(v10, 9) FROM v
UNION ALL SELECT 0, 1, round(v01, 9) FROM v
UNION ALL SELECT 1, 1, round(v11, 9) FROM v""")
def q_svd_vectors(spark, sf):
    return svd.right_vectors_frame(spark, _svd(spark, sf, 2)).select(
        "j", "k_idx", R("v", 9).alias("v"))


@register("svd_reconstruct", f"""
WITH {O.SVD2}, pr AS (SELECT p_partkey, (x0 * v00 + x1 * v10) AS t, v00, v10 FROM pp, v)
SELECT p_partkey, CAST(0 AS BIGINT) AS j, round(t * v00, 5) AS xhat FROM pr
UNION ALL SELECT p_partkey, 1, round(t * v10, 5) FROM pr""")
def q_svd_reconstruct(spark, sf):
    res = _svd(spark, sf, 1)
    out = svd.reconstruct(part2(spark, sf), "features", res.V, keep=["p_partkey"])
    return _long(out, "p_partkey", "features_hat", "j", "xhat", digits=5)


_SVD_ERR = f"""
WITH {O.SVD2}, pr AS (SELECT x0, x1, (x0 * v00 + x1 * v10) AS t, v00, v10 FROM pp, v),
s AS (SELECT sum((x0 - t * v00) * (x0 - t * v00) + (x1 - t * v10) * (x1 - t * v10)) AS err,
             sum(x0 * x0 + x1 * x1) AS fro_sq FROM pr)"""


@register("svd_relative_error", _SVD_ERR + """
SELECT round(err, 5) AS err, round(fro_sq, 4) AS fro_sq, round(err / fro_sq, 10) AS relative_error FROM s""")
def q_svd_error(spark, sf):
    res = _svd(spark, sf, 1)
    out = svd.approximation_error(part2(spark, sf), "features", res.V)
    return out.select(R("err", 5).alias("err"), R("fro_sq", 4).alias("fro_sq"),
                      R("relative_error", 10).alias("relative_error"))


@register("pipeline_svd_error", _SVD_ERR + """
SELECT round(err, 5) AS err, round(fro_sq, 4) AS fro_sq, round(err / fro_sq, 10) AS relative_error,
       CAST(1 AS BIGINT) AS rank FROM s""")
def q_pipeline_svd(spark, sf):
    run = pipelines.svd_error(part2(spark, sf), 1, d=2)
    return run.error.select(R("err", 5).alias("err"), R("fro_sq", 4).alias("fro_sq"),
                            R("relative_error", 10).alias("relative_error"), "rank")


PAIR_ROWS = 40                    # rows of each block whose pairs are taken


@register("pairwise_sqdist", f"""
WITH {O.EMB}, firsts AS (
  SELECT label, vec_id, x FROM pts QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {PAIR_ROWS})
SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, round({O.sqdist_sql('a.x', 'b.x')}, 8) AS sqdist
FROM firsts a JOIN firsts b ON b.label = a.label""")
def q_pairwise(spark, sf):
    out = stats.pairwise_sqdist(emb(spark, sf), "label", "vec_id", "features", EMB_D, PAIR_ROWS)
    return out.select("block", "a", "b", R("sqdist", 8).alias("sqdist"))


def _array_files(spark, sf):
    path = scratch_path(spark, "array-files")
    array_files.write_array_files(emb(spark, sf), path, EMB_D, "features", "vec_id")
    return path


@register("array_file_scan", f"WITH {O.EMB}, {O.emb_long()} SELECT vec_id, j, v AS x FROM el")
def q_array_scan(spark, sf):
    """embeddings -> array files -> scan by row range."""
    rows = array_files.read_array_files(spark, _array_files(spark, sf), split_rows=256)
    return matrix.to_long(rows).withColumnRenamed("id", "vec_id")


@register("array_file_rows", f"""
WITH {O.EMB}, h AS (SELECT * FROM pts ORDER BY vec_id LIMIT 130 OFFSET 70)
SELECT vec_id, CAST(unnest(range(len(x))) AS BIGINT) AS j, unnest(x) AS x FROM h""")
def q_array_rows(spark, sf):
    """Rows 70 to 199 of the whole matrix: only their ranges are planned and mapped."""
    rows = array_files.read_array_files(spark, _array_files(spark, sf), 70, 200)
    return matrix.to_long(rows).withColumnRenamed("id", "vec_id")


@register("sqdist_to_mean", f"""
WITH {O.EMB}, {O.emb_long()}, mu AS (SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(v) AS m FROM el GROUP BY j))
SELECT vec_id, round({O.sqdist_sql('x', 'm')}, 8) AS sqdist FROM pts, mu""")
def q_sqdist(spark, sf):
    e = emb(spark, sf)
    mean = e.agg(*[F.avg(F.col("features")[j]).alias(f"m{j}") for j in range(EMB_D)]).first()
    center = [float(mean[f"m{j}"]) for j in range(EMB_D)]
    return e.select("vec_id", R(V.sqdist_const("features", center), 8).alias("sqdist"))


# ---------------------------------------------------------------------------
# A1 / A2 / A3: file formats
# ---------------------------------------------------------------------------

@register("libsvm_scan", f"WITH {O.sparse(SPARSE_D)} SELECT id, j, x FROM sp")
def q_libsvm_scan(spark, sf):
    rows = sparse_rows(spark, sf)
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(rows, "id", "features", path)
    back = libsvm.read_libsvm(spark, path, SPARSE_D, label_cast="double")
    out = back.select(F.col("label").cast("long").alias("id"), F.posexplode("features").alias("j", "x"))
    return out.filter(F.col("x") != 0).select("id", F.col("j").cast("long"), "x")


@register("libsvm_text_parse", f"WITH {O.sparse(SPARSE_D)} SELECT id, j + 1 AS j, x FROM sp")
def q_libsvm_parse(spark, sf):
    lines = libsvm.format_libsvm(sparse_rows(spark, sf), "id", "features")
    parsed = libsvm.parse_libsvm_lines(lines, index_base=0)
    out = parsed.select(F.col("label").cast("long").alias("id"), F.explode("features").alias("j", "x"))
    return out.select("id", F.col("j").cast("long"), "x")


@register("csv_labeled_scan", """
SELECT CAST(p_size - 1 AS INTEGER) AS label, p_retailprice AS f0, p_size / CAST(2 AS DOUBLE) AS f1 FROM part""")
def q_csv_labeled(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(
        (F.col("p_size") - 1).alias("label"),
        F.array("p_retailprice", F.col("p_size") / F.lit(2.0)).alias("features"))
    path = scratch_path(spark, "labeled-csv")
    csv_src.write_labeled_csv(p, path, 2)
    back = csv_src.read_labeled_csv(spark, path, d=2)
    return back.select("label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


# ---------------------------------------------------------------------------
# E2' / E3: random-feature pipelines
# ---------------------------------------------------------------------------

_G3 = feat.rff_params(3, E2R_S, 1.0)  # Z for sigma = 1; divided by the estimate below


def _rfm_regression_sql() -> str:
    z, v = _G3
    feats = []
    for i in range(E2R_S):
        dot = " + ".join(f"x{j} * ({O.lit(z[i, j])} / sg)" for j in range(3))
        feats.append(f"sqrt(2.0 / {E2R_S}) * cos({dot} + {O.lit(v[i])}) AS r{i}")
    ctes = (O.li_scaled() + ", bw AS (SELECT sqrt(2 * (var_pop(x0) + var_pop(x1) + var_pop(x2))) AS sg FROM lis), "
            f"rf0 AS (SELECT {', '.join(feats)}, y FROM lis, bw), "
            f"rf AS (SELECT {', '.join(f'r{i} AS x{i}' for i in range(E2R_S))}, y FROM rf0)")
    return _ridge_fit_sql(ctes, "rf", GAMMA_SCALED, 6)


@register("pipeline_rfm_regression", _rfm_regression_sql())
def q_pipeline_rfm_regression(spark, sf):
    run = pipelines.rfm_regression(li(spark, sf), GAMMA_SCALED, E2R_S, d=3)
    return run.weights.select("j", R("weight", 6).alias("weight"))


def _rfm_class_sql() -> str:
    z, v = feat.rff_params(EMB_D, E3_S, RFF_SIGMA)
    feats = ", ".join(
        f"sqrt(2.0 / {E3_S}) * cos(list_dot_product(x, {O.dlist(z[i])}) + {O.lit(v[i])}) AS x{i}"
        for i in range(E3_S))
    src = O.EMB + f", rf AS (SELECT vec_id, label, {feats} FROM pts)"
    return f"""
WITH {_mt_ctes(src, 'rf', MT_GAMMA)}, {_mt_scores('rf')}
SELECT CAST(sum(CASE WHEN prediction <> label THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       CAST(count(*) AS BIGINT) AS n,
       round(sum(CASE WHEN prediction <> label THEN 1 ELSE 0 END) / count(*), 10) AS rate FROM pr"""


@register("pipeline_rfm_classification", _rfm_class_sql())
def q_pipeline_rfm_class(spark, sf):
    run = pipelines.rfm_classification(emb(spark, sf), K, E3_S, MT_GAMMA, RFF_SIGMA, d=EMB_D)
    return run.errors.select("errors", "n", R("rate", 10).alias("rate"))


# ---------------------------------------------------------------------------
# E1 / E2 / E3 started from files, as the original drivers run them
# ---------------------------------------------------------------------------

@register("pipeline_kmeans_nmi_libsvm", O.nmi_sql(_KM, _A, "label", "prediction"))
def q_pipeline_kmeans_libsvm(spark, sf):
    """embeddings -> libsvm files -> k-means (initial centres: the k lowest
    vec_ids of the table) -> label/prediction text files -> NMI."""
    e = emb(spark, sf)
    init = kmeans.first_rows_init(e, "features", K, "vec_id")
    path = scratch_path(spark, "e1-libsvm")
    libsvm.write_libsvm(e, "label", "features", path)
    score = pipelines.kmeans_nmi_libsvm(spark, path, K, EMB_D, scratch_path(spark, "e1-pairs"),
                                        max_iter=KM_ITERS, init="given", initial_centers=init,
                                        epsilon=0.0)
    return _nmi_cols(score)


@register("pipeline_ridge_regression_libsvm",
          O.cg_history_sql(O.li_scaled(O.LI_FLOAT_LABEL), "lis", GAMMA_SCALED, 6))
def q_pipeline_ridge_libsvm(spark, sf):
    """lineitem -> libsvm files -> label via float -> centre/scale -> CG."""
    path = scratch_path(spark, "e2-libsvm")
    libsvm.write_libsvm(li(spark, sf), "label", "features", path)
    run = pipelines.ridge_regression_libsvm(spark, path, 3, GAMMA_SCALED)
    return run.history.select("iter", R("objective", 6).alias("objective"),
                              R("train_error", 6).alias("train_error"))


@register("pipeline_rfm_classification_csv", _rfm_class_sql())
def q_pipeline_rfm_class_csv(spark, sf):
    """embeddings -> headerless CSV (1-based class) -> RFF -> block CG -> errors."""
    path = scratch_path(spark, "e3-csv")
    csv_src.write_labeled_csv(emb(spark, sf), path, EMB_D)
    run = pipelines.rfm_classification_csv(spark, path, K, E3_S, MT_GAMMA, RFF_SIGMA,
                                           num_features=EMB_D)
    return run.errors.select("errors", "n", R("rate", 10).alias("rate"))


@register("pipeline_svd_error_parquet", _SVD_ERR + """
SELECT round(err, 5) AS err, round(fro_sq, 4) AS fro_sq, round(err / fro_sq, 10) AS relative_error,
       CAST(1 AS BIGINT) AS rank FROM s""")
def q_pipeline_svd_parquet(spark, sf):
    """part -> a row matrix stored as wide numeric Parquet columns (the
    2-D array dataset, re-aimed) -> matrix scan -> SVD -> rank-1 error."""
    path = scratch_path(spark, "e4-matrix")
    part2(spark, sf).select(F.col("p_partkey").alias("row_id"),
                            F.col("features")[0].alias("c0"),
                            F.col("features")[1].alias("c1")).write.parquet(path)
    a = matrix.read_matrix(spark, path, ["c0", "c1"], id_col="row_id")
    run = pipelines.svd_error(a, 1, d=2)
    return run.error.select(R("err", 5).alias("err"), R("fro_sq", 4).alias("fro_sq"),
                            R("relative_error", 10).alias("relative_error"), "rank")


from . import wide  # noqa: E402,F401 - registers the queries on whole embedding rows
