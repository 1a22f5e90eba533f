"""The four end-to-end analyses (plus the random-feature regression
variant), each a short chain of library operators.

E1 k-means + NMI        : matrix -> k-means fit -> assignment -> NMI
E2 ridge regression     : (label, features) -> centre/scale -> CG -> history
E2' RFF ridge regression: ... -> bandwidth -> random Fourier features -> CG
E3 RFF classification   : (class, features) -> RFF -> one-hot -> block CG
                          -> training misclassification
E4 truncated SVD        : matrix -> ||A||_F² -> SVD -> rank-k error
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import kmeans, nmi, ridge, stats, svd
from ..operators.sparse import is_sparse
from ..session import cached, durable
from ..sources.matrix import partition_control


def infer_dim(df: DataFrame, features: str = "features") -> int:
    """Row length from the first row (reads one split) when the caller does
    not pass ``d``. Every kernel re-checks the length of every row it
    touches, in the same pass."""
    row = df.select(F.col(features)["size"] if is_sparse(df, features) else F.size(features)).first()
    if row is None:
        raise ValueError("empty matrix")
    return int(row[0])


@dataclass
class KMeansNmi:
    fit: kmeans.KMeansResult
    assignments: DataFrame
    score: DataFrame


def kmeans_nmi(df: DataFrame, k: int, features: str = "features", label: str = "label",
               max_iter: int = 20, init: str = "k-means||", order_by: str = "id",
               epsilon: float = 1e-4, seed: int = 42, d: int | None = None) -> KMeansNmi:
    d = d or infer_dim(df, features)
    fit = kmeans.kmeans_fit(df, features, k, d, max_iter=max_iter, init=init,
                            order_by=order_by, epsilon=epsilon, seed=seed)
    keep = [c for c in (order_by, label) if c in df.columns]
    assigned = kmeans.assign(df, features, fit.centers, keep=keep)
    return KMeansNmi(fit, assigned, nmi.nmi(assigned, label, "prediction"))


@dataclass
class RidgeRun:
    result: ridge.RidgeResult
    stats: stats.ScaleStats | None
    history: DataFrame
    weights: DataFrame


def ridge_regression(df: DataFrame, gamma: float, features: str = "features",
                     label: str = "label", max_iter: int = 500, normalize: bool = True,
                     num_splits: int | None = None, rel_tol: float | None = 1e-10,
                     d: int | None = None) -> RidgeRun:
    spark = df.sparkSession
    d = d or infer_dim(df, features)
    sc = rows = None
    data = df.select(label, features)
    if normalize and is_sparse(df, features):                 # scaled inside the passes, so that rows stay sparse
        sc = stats.sparse_scale_stats(data, label, features, d)
        data = data.select((F.col(label).cast("double") - F.lit(sc.label_mean)).alias(label), features)
        rows = feat.ScaleMap(spark, sc.max_abs)
    elif normalize:
        data, sc = stats.center_maxabs_scale(data, label, features, d)
    data = partition_control(data, num_splits, coalesce=False)
    res = ridge.ridge_cg(data, features, label, gamma, d, max_iter=max_iter, rel_tol=rel_tol, rows=rows)
    if rows is not None:
        rows.release()
    return RidgeRun(res, sc, ridge.history_frame(spark, res.history),
                    ridge.weights_frame(spark, res.weights))


def _hold(df: DataFrame, durable_features: bool) -> DataFrame:
    """Keep a derived feature frame for an iterative loop: persisted by
    default (recomputed from lineage on executor loss), or written as a
    reliable checkpoint in the shared checkpoint folder when the map is
    expensive enough that recomputation should be avoided."""
    return durable(df) if durable_features else cached(df)


def rfm_regression(df: DataFrame, gamma: float, num_random: int,
                   features: str = "features", label: str = "label", sigma: float | None = None,
                   max_iter: int = 500, rng: str = "java48",
                   rel_tol: float | None = 1e-10, durable_features: bool = False,
                   d: int | None = None, method: str = "auto") -> RidgeRun:
    """E2 with the random-feature step enabled; sigma defaults to the
    bandwidth estimate of the scaled features. The map is applied inside every
    pass (``durable_features`` stores the mapped rows instead)."""
    spark = df.sparkSession
    d = d or infer_dim(df, features)
    data, sc = stats.center_maxabs_scale(df.select(label, features), label, features, d)
    if sigma is None:
        sigma = stats.bandwidth_value(data, features, d)
    with _mapped(data, features, label, d, num_random, sigma, rng, durable_features) as (rows, phi):
        res = ridge.ridge_cg(rows, features, label, gamma, num_random, max_iter=max_iter, rel_tol=rel_tol,
                             method=method, rows=phi)
    return RidgeRun(res, sc, ridge.history_frame(spark, res.history),
                    ridge.weights_frame(spark, res.weights))


@contextmanager
def _mapped(df: DataFrame, features: str, label: str, d: int, s: int, sigma: float, rng: str, stored: bool):
    """(frame, row map): the input with the map to apply to it, or the stored mapped rows without one."""
    if stored:
        mapped = _hold(feat.rbf_random_features(df, features, d, s, sigma, keep=[label], rng=rng), True)
        try:
            yield mapped, None
        finally:
            mapped.unpersist()
        return
    phi = feat.fourier_map(df.sparkSession, d, s, sigma, rng)
    try:
        yield df.select(features, label), phi
    finally:
        phi.release()


@dataclass
class RfmClassification:
    result: ridge.RidgeResult
    sigma: float
    errors: DataFrame


def rfm_classification(df: DataFrame, num_classes: int, num_random: int, gamma: float,
                       sigma: float, features: str = "features", label: str = "label",
                       max_iter: int = 500, rng: str = "java48",
                       rel_tol: float | None = 1e-10,
                       durable_features: bool = False,
                       d: int | None = None, method: str = "auto") -> RfmClassification:
    """Kernel ridge classification: RFF map, one-hot targets (both inside the
    data pass), block CG, training misclassification. No mapped row is ever
    stored, unless ``durable_features`` asks for it."""
    d = d or infer_dim(df, features)
    with _mapped(df, features, label, d, num_random, sigma, rng, durable_features) as (rows, phi):
        res = ridge.ridge_multitask_cg(rows, features, label, gamma, num_random, num_classes,
                                       label_kind="class", max_iter=max_iter, rel_tol=rel_tol,
                                       method=method, rows=phi)
        row = ridge.misclassification(rows, features, label, res.weights, rows=phi).first()
    errors = df.sparkSession.createDataFrame(
        [(int(row["errors"]), int(row["n"]), float(row["rate"]))],
        "errors long, n long, rate double")
    return RfmClassification(res, sigma, errors)


@dataclass
class SvdRun:
    result: svd.SvdResult
    error: DataFrame


def svd_error(df: DataFrame, k: int, features: str = "features", method: str = "auto",
              d: int | None = None) -> SvdRun:
    d = d or infer_dim(df, features)
    data = cached(df.select(features))
    try:
        res = svd.truncated_svd(data, features, k, d, method=method)
        row = svd.approximation_error(data, features, res.V).first()
    finally:
        data.unpersist()
    spark = df.sparkSession
    out = spark.createDataFrame([(float(row["err"]), float(row["fro_sq"]),
                                  None if row["relative_error"] is None else float(row["relative_error"]),
                                  int(res.sigma.size))],
                                "err double, fro_sq double, relative_error double, rank long")
    return SvdRun(res, out)


# ---------------------------------------------------------------------------
# The same analyses started from files, as the original drivers run them
# ---------------------------------------------------------------------------

def kmeans_nmi_libsvm(spark, path: str, k: int, num_features: int | None, out_path: str,
                      max_iter: int = 20, init: str = "k-means||", initial_centers=None,
                      epsilon: float = 1e-4, seed: int = 42) -> DataFrame:
    """E1 from files: libsvm (label text -> float -> int) -> k-means ->
    "label pred" text lines written by the tasks -> read back -> NMI."""
    from ..sources import libsvm as libsvm_src
    from ..sources import matrix as matrix_src

    data = cached(libsvm_src.read_libsvm_sparse(spark, path, num_features, label_cast="float_int"))
    try:
        d = num_features if num_features is not None else infer_dim(data)
        fit = kmeans.kmeans_fit(data, "features", k, d, max_iter=max_iter, init=init,
                                initial_centers=initial_centers, epsilon=epsilon, seed=seed)
        assigned = kmeans.assign(data, "features", fit.centers, keep=["label"])
        matrix_src.write_label_pred(assigned, out_path)
    finally:
        data.unpersist()
    return nmi.nmi(matrix_src.read_label_pred(spark, out_path), "label", "prediction")


def ridge_regression_libsvm(spark, path: str, num_features: int | None, gamma: float,
                            num_splits: int | None = None, max_iter: int = 500,
                            rel_tol: float | None = 1e-10) -> RidgeRun:
    """E2 from files: libsvm (label text -> float -> double) -> centre and
    max-abs scale -> repartition -> CG -> history."""
    from ..sources import libsvm as libsvm_src

    data = libsvm_src.read_libsvm_sparse(spark, path, num_features, label_cast="float_double")
    return ridge_regression(data, gamma, num_splits=num_splits, max_iter=max_iter,
                            rel_tol=rel_tol, d=num_features)


def rfm_classification_csv(spark, path: str, num_classes: int, num_random: int, gamma: float,
                           sigma: float, num_features: int | None = None,
                           num_splits: int | None = None, max_iter: int = 500,
                           rng: str = "java48") -> RfmClassification:
    """E3 from files: headerless CSV (1-based class, features) -> coalesce
    -> RFF -> one-hot -> block CG -> training misclassification."""
    from ..sources import csv as csv_src

    data = csv_src.read_labeled_csv(spark, path, d=num_features, num_splits=num_splits)
    return rfm_classification(data, num_classes, num_random, gamma, sigma,
                              max_iter=max_iter, rng=rng, d=num_features)


__all__ = ["infer_dim", "kmeans_nmi", "ridge_regression", "rfm_regression",
           "rfm_classification", "svd_error", "kmeans_nmi_libsvm",
           "ridge_regression_libsvm", "rfm_classification_csv"]
