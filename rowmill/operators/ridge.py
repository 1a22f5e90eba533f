"""Ridge regression by conjugate gradient, single- and multi-output.

Problem: minimise 1/(2n)·||Xw - y||² + γ/2·||w||², i.e. solve
(X'X + nγI) w = X'y, with n the row count (γ is per-sample).

Physical plan:

* ``gram`` (d up to GRAM_MAX_D): one distributed pass collects X'X, X'Y,
  Y'Y and n (model-sized); all CG iterations then run on the driver with
  no further jobs.
* ``matrix_free`` (wide d): the frame is persisted and every iteration is
  one job computing X'X P for the d×k direction block P.

The training errors of all recorded iterates are summed from row residuals in
one pass after the last iteration.

Driver state is O(d·k). Stop rules: the absolute test of the original
(r·r < 1e-18·d single-output, Σ r_c·r_c < 1e-8 multi-output) plus a
relative test (r·r <= rel_tol²·r0·r0) that also stops unscaled problems.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks
from .moments import moments
from .sparse import is_sparse

GRAM_MAX_D = 2048


# ---------------------------------------------------------------------------
# Evaluation of a given linear model (one pass each)
# ---------------------------------------------------------------------------

def linear_score(df: DataFrame, features: str, w, keep: list[str] | None = None) -> DataFrame:
    """ŷ = x·w per row."""
    return df.select(*(keep or []), V.dot_const(features, w).alias("score"))


def residual_sq(features: str, label: str, w) -> F.Column:
    y = V.required(F.col(label).cast("double"), None, "label is null")
    r = V.dot_const(features, w) - y
    return r * r


def ridge_objective(df: DataFrame, features: str, label: str, w, gamma: float) -> DataFrame:
    """``(train_error, objective)`` at w: ||Xw-y||²/n and
    (||Xw-y||² + nγ||w||²)/(2n)."""
    wn = float(np.dot(w, w))
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(residual_sq(features, label, w)).alias("sse"))
    return agg.select(
        (F.col("sse") / F.col("n")).alias("train_error"),
        ((F.col("sse") + F.col("n") * F.lit(gamma * wn)) / (F.lit(2.0) * F.col("n"))).alias("objective"))


def ridge_gradient(df: DataFrame, features: str, label: str, w, gamma: float) -> DataFrame:
    """Unnormalised gradient g = X'(Xw - y) + nγw as ``(j, grad, train_error,
    objective)``: the error and objective at w come from the same pass and are
    repeated on each row."""
    w = [float(v) for v in w]
    d = len(w)
    res = V.dot_const(features, w) - V.required(F.col(label).cast("double"), None, "label is null")
    src = df.select(F.col(features).alias("x"), res.alias("res"))
    x = F.col("x")
    row = src.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("res") * F.col("res")).alias("sse"),
                  *[F.sum(x[j] * F.col("res")).alias(f"g{j}") for j in range(d)])
    penalty = F.col("n") * F.lit(gamma * float(np.dot(w, w)))
    return row.select(
        F.explode(F.array(*[
            F.struct(F.lit(j).cast("long").alias("j"),
                     (F.col(f"g{j}") + F.col("n") * F.lit(gamma * w[j])).alias("grad"))
            for j in range(d)])).alias("c"),
        (F.col("sse") / F.col("n")).alias("train_error"),
        ((F.col("sse") + penalty) / (F.lit(2.0) * F.col("n"))).alias("objective")
    ).select("c.*", "train_error", "objective")


def linear_mse(df: DataFrame, features: str, label: str, w) -> DataFrame:
    return df.agg(F.avg(residual_sq(features, label, w)).alias("mse"))


# Up to this many score terms (k·d) class scores are plain Column
# arithmetic (codegen); above it one GEMM per Arrow batch computes them.
SCORE_EXPR_TERMS = 64


def class_scores(features: str, W: np.ndarray) -> F.Column:
    """Array of k scores x·W[:, c]."""
    W = np.asarray(W, dtype=np.float64)
    return F.array(*[V.dot_const(features, W[:, c]) for c in range(W.shape[1])])


def _argmax_rows(x: np.ndarray, W: np.ndarray) -> np.ndarray:
    return np.argmax(x @ W, axis=1)        # first maximum wins, as array_position


def predict_class(df: DataFrame, features: str, W, keep: list[str] | None = None,
                  rows: blocks.RowMap | None = None) -> DataFrame:
    """Argmax class of x·W (first maximum wins); row-local. With ``rows`` x is the
    mapped row."""
    W = np.asarray(W, dtype=np.float64)
    keep = list(keep or [])
    if W.size <= SCORE_EXPR_TERMS and rows is None and not is_sparse(df, features):
        return df.select(*keep, V.argmax(class_scores(features, W)).alias("prediction"))
    import pyarrow as pa
    d = W.shape[0]
    handle = blocks.ship(df.sparkSession, W)
    src = df.select(*keep, features)
    kept = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["prediction int"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = {name: b.column(name) for name in keep}
            best = [_argmax_rows(x, handle.value) for _, _, x in blocks.pieces(b, features, d, rows)]
            cols["prediction"] = pa.array(np.concatenate(best).astype(np.int32))
            yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, schema)


def misclassification(df: DataFrame, features: str, label: str, W,
                      label_kind: str = "class", rows: blocks.RowMap | None = None) -> DataFrame:
    """``(errors, n, rate)``: rows whose argmax score differs from the label
    (a class id, or the argmax of a one-hot vector)."""
    W = np.asarray(W, dtype=np.float64)
    if W.size <= SCORE_EXPR_TERMS and rows is None and not is_sparse(df, features):
        pred = V.argmax(class_scores(features, W))
        truth = (V.required(F.col(label).cast("int"), None, "label is null") if label_kind == "class"
                 else V.argmax(label))
        agg = df.agg(F.sum(F.when(pred != truth, 1).otherwise(0)).cast("long").alias("errors"),
                     F.count(F.lit(1)).alias("n"))
    else:
        d, k = W.shape
        handle = blocks.ship(df.sparkSession, W)

        def update(state, b):
            if label_kind == "class":
                truth = blocks.to_vector(b.column(label), label).astype(np.int64)
            else:
                truth = np.argmax(blocks.to_matrix(b.column(label), k, label), axis=1)
            wrong = sum(np.count_nonzero(_argmax_rows(x, handle.value) != truth[lo:hi])
                        for lo, hi, x in blocks.pieces(b, features, d, rows))
            part = np.array([wrong, b.num_rows], dtype=np.float64)
            return part if state is None else state + part

        cells = blocks.partial_sums(df, [features, label], update, lambda st: st, 2)
        agg = cells.agg(F.sum(F.when(F.col("idx") == 0, F.col("v"))).cast("long").alias("errors"),
                        F.sum(F.when(F.col("idx") == 1, F.col("v"))).cast("long").alias("n"))
    return agg.select("errors", "n", (F.col("errors") / F.col("n")).alias("rate"))


# ---------------------------------------------------------------------------
# CG solvers
# ---------------------------------------------------------------------------

@dataclass
class RidgeResult:
    weights: np.ndarray              # d (single) or d x k (multi)
    history: list = field(default_factory=list)
    n: int = 0
    iterations: int = 0
    converged: bool = False
    method: str = "gram"
    elapsed: list = field(default_factory=list)   # seconds since training start, per history row
    residuals: list = field(default_factory=list)  # multi-output: r_c·r_c of every output, per history row


class _GramOperator:
    """Applies X'X to a block on the driver (Gram path)."""

    def __init__(self, xx):
        self.xx = xx

    def __call__(self, p):
        return self.xx @ p


class _DistributedOperator:
    """Applies X'X to a block with one Spark job."""

    def __init__(self, df, features, d, k, partitions, rows=None):
        self.src = blocks.prepare(df, [features], d * k, partitions=partitions)   # planned once
        self.features, self.d, self.rows = features, d, rows

    def __call__(self, p):
        return blocks.gram_times(self.src, self.features, self.d, p, self.rows)


def _prepare(df: DataFrame, features: str, label: str, d: int, k: int,
             label_kind: str, method: str, persist: bool = True, rows: blocks.RowMap | None = None):
    if method == "auto":
        method = "gram" if d <= GRAM_MAX_D else "matrix_free"
    if method == "gram":
        m = moments(df, features, d, label, k, label_kind, rows=rows)
        return method, m, _GramOperator(m.xx), None
    passes = blocks.persist_for_passes(df, [features, label], persist)
    parts = _cross_only(passes.df, features, d, label, k, label_kind, rows)
    return method, parts, _DistributedOperator(passes.df, features, d, k, passes.partitions, rows), passes


def _cross_only(df, features, d, label, k, label_kind, rows=None):
    """n, X'Y and diag(Y'Y) without X'X (matrix-free path)."""
    parts = blocks.normal_equation_partials(df, features, d, label, k, label_kind,
                                            with_xx=False, rows=rows)
    return blocks.collect_moments(parts, d, k, with_xx=False)


EVALUATE_BYTES = 32 << 20      # iterates shipped to one evaluation pass


SUM_TERMS = 64                 # weights of all iterates up to which errors are plain sums (codegen)


def residual_sums(df: DataFrame, features: str, label: str, d: int, iterates: np.ndarray,
                  rows: blocks.RowMap | None = None) -> np.ndarray:
    """||X w - y||² for every column w of ``iterates`` (d x h), summed over row
    residuals: no digits are lost to cancellation. One pass for all columns (plain
    sums for few weights, Arrow blocks beyond), or a pass per ``EVALUATE_BYTES`` of
    them."""
    if rows is None and 0 < iterates.size <= SUM_TERMS and not is_sparse(df, features):
        sums = [F.sum(residual_sq(features, label, w)) for w in iterates.T]
        return np.array([v or 0.0 for v in df.agg(*sums).first()])
    step = max(1, EVALUATE_BYTES // (8 * d))
    out = []
    for a in range(0, iterates.shape[1], step):
        w = iterates[:, a:a + step]
        handle = blocks.ship(df.sparkSession, w)

        def update(state, b, handle=handle):
            y = blocks.to_vector(b.column(label), label)
            for lo, hi, x in blocks.pieces(b, features, d, rows):
                r = x @ handle.value - y[lo:hi, None]
                part = np.einsum("nh,nh->h", r, r)
                state = part if state is None else state + part
            return state

        part = blocks.partial_frame(df, [features, label], update, lambda st: st, w.shape[1])
        out.append(blocks.reduce_vector(part, w.shape[1]))
        blocks.release(handle)
    return np.concatenate(out) if out else np.zeros(0)


def ridge_cg(df: DataFrame, features: str, label: str, gamma: float, d: int,
             max_iter: int = 500, rel_tol: float | None = 1e-10,
             method: str = "auto", record_every: int = 2, persist: bool = True,
             rows: blocks.RowMap | None = None) -> RidgeResult:
    """Single-output ridge by CG from w0 = 0. With ``rows`` the matrix is that of
    the mapped rows (d its width), mapped anew inside every pass.

    History rows ``(iter, objective, train_error)`` are recorded at every
    ``record_every``-th iteration t (t = 0, 2, 4, ...) after that step's
    update and before the stop test.
    """
    t0 = time.perf_counter()
    method, m, apply_xx, frame = _prepare(df, features, label, d, 1, "scalar", method, persist, rows)
    try:
        n = m.n
        elapsed = []
        b = m.xy[:, 0]
        ng = n * gamma
        w = np.zeros(d)
        r = b.copy()                 # b - ng*w - X'X w with w = 0
        p = r.copy()
        rs = float(r @ r)
        rs0 = rs
        tol_abs = 1e-18 * d
        hist = []
        it, converged = 0, False
        for t in range(max_iter):
            it = t + 1
            xxp = apply_xx(p[:, None])[:, 0]
            ap = ng * p + xxp
            pap = float(p @ ap)
            alpha = rs / pap if pap != 0.0 else 0.0
            w = w + alpha * p
            r = r - alpha * ap
            rs_new = float(r @ r)
            if t % record_every == 0:
                hist.append((t, w))
                elapsed.append(time.perf_counter() - t0)
            if rs_new < tol_abs or (rel_tol is not None and rs_new <= rel_tol * rel_tol * rs0):
                converged = True
                break
            beta = rs_new / rs if rs != 0.0 else 0.0
            p = r + beta * p
            rs = rs_new
        sse = residual_sums(frame.df if frame is not None else df, features, label, d,
                            np.array([v for _, v in hist]).T, rows) if n and hist else np.zeros(len(hist))
        hist = [(t, (s + ng * float(v @ v)) / (2.0 * n), s / n) if n else (t, 0.0, 0.0)
                for (t, v), s in zip(hist, sse.tolist())]
        return RidgeResult(w, hist, int(n), it, converged, method, elapsed)
    finally:
        if frame is not None:
            frame.release()


def ridge_multitask_cg(df: DataFrame, features: str, label: str, gamma: float, d: int, k: int,
                       label_kind: str = "class", max_iter: int = 500,
                       tol: float = 1e-8, rel_tol: float | None = 1e-10,
                       method: str = "auto", persist: bool = True,
                       rows: blocks.RowMap | None = None) -> RidgeResult:
    """k independent CGs sharing each data pass (block CG); ``rows`` as in
    :func:`ridge_cg`.

    ``label`` is a class id in [0, k) (one-hot encoded inside the pass) or a
    k-vector. A column whose residual or curvature is exactly zero (a class
    without rows, or an output already solved) keeps α = β = 0 instead of
    turning NaN. History rows: ``(iter, residual_sq)`` with Σ_c r_c·r_c.
    """
    t0 = time.perf_counter()
    method, m, apply_xx, frame = _prepare(df, features, label, d, k, label_kind, method, persist, rows)
    try:
        n = m.n
        elapsed = []
        ng = n * gamma
        W = np.zeros((d, k))
        R = m.xy.copy()
        P = R.copy()
        rs = (R * R).sum(axis=0)
        rs0 = float(rs.sum())
        hist, residuals = [], []
        it, converged = 0, False
        for t in range(max_iter):
            it = t + 1
            AP = ng * P + apply_xx(P)
            pap = (P * AP).sum(axis=0)
            alpha = np.divide(rs, pap, out=np.zeros(k), where=(pap != 0.0) & (rs != 0.0))
            W += alpha * P
            R -= alpha * AP
            rs_new = (R * R).sum(axis=0)
            total = float(rs_new.sum())
            hist.append((t, total))
            residuals.append(rs_new.copy())
            elapsed.append(time.perf_counter() - t0)
            if total < tol or (rel_tol is not None and total <= rel_tol * rel_tol * rs0):
                converged = True
                break
            beta = np.divide(rs_new, rs, out=np.zeros(k), where=rs != 0.0)
            P = R + beta * P
            rs = rs_new
        return RidgeResult(W, hist, int(n), it, converged, method, elapsed, residuals)
    finally:
        if frame is not None:
            frame.release()


# ---------------------------------------------------------------------------
# Model-sized results as DataFrames
# ---------------------------------------------------------------------------

def weights_frame(spark: SparkSession, w: np.ndarray) -> DataFrame:
    w = np.asarray(w)
    if w.ndim == 1:
        return spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)],
                                     "j long, weight double")
    return spark.createDataFrame(
        [(j, c, float(w[j, c])) for j in range(w.shape[0]) for c in range(w.shape[1])],
        "j long, c long, weight double")


def history_report(spark: SparkSession, res: RidgeResult) -> DataFrame:
    """Training history with elapsed seconds, for display (``.show()``):
    ``(iter, objective, train_error, elapsed_sec)``; timings are not part of
    any value-checked output."""
    if res.residuals:
        return spark.createDataFrame(
            [(int(t), float(v), float(s)) for (t, v), s in zip(res.history, res.elapsed)],
            "iter long, residual_sq double, elapsed_sec double")
    rows = [(int(t), float(o), float(e), float(s))
            for (t, o, e), s in zip(res.history, res.elapsed)]
    return spark.createDataFrame(rows, "iter long, objective double, train_error double, "
                                       "elapsed_sec double")


def residual_frame(spark: SparkSession, res: RidgeResult) -> DataFrame:
    """Residual of every output at every iteration: ``(iter, c, rs)``."""
    return spark.createDataFrame(
        [(int(t), c, float(v)) for (t, _), rs in zip(res.history, res.residuals) for c, v in enumerate(rs)],
        "iter long, c long, rs double")


def history_frame(spark: SparkSession, hist: list, multi: bool = False) -> DataFrame:
    if multi:
        return spark.createDataFrame([(int(t), float(v)) for t, v in hist],
                                     "iter long, residual_sq double")
    return spark.createDataFrame([(int(t), float(o), float(e)) for t, o, e in hist],
                                 "iter long, objective double, train_error double")
