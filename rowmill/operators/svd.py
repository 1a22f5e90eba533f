"""Truncated SVD of a row matrix A (n x d, rows in a DataFrame), right
factors only, and its approximation error.

* ``gram`` (d up to GRAM_MAX_D): one distributed pass for A'A (d x d,
  upper triangle partials), eigen-decomposition on the driver. This is
  what MLlib does for tall-and-skinny matrices, without moving rows
  through Python pickling.
* ``tsqr``: every task folds its batches into one triangular factor R by QR;
  the R of all tasks are folded by a tree of shuffles, and the SVD of the last
  R gives sigma and V to full precision (A'A is never formed).
* ``krylov`` (wide d): block Krylov space of A'A with full
  reorthogonalisation. Every pass computes A'A Q for the block of residuals of
  the leading Ritz vectors; products are kept, so the Rayleigh-Ritz step and its
  residuals need no pass. A space of ``MAX_BASIS`` blocks is restarted from its
  leading Ritz vectors.
* ``subspace``: block subspace iteration, one pass per iteration, with no more
  state than one block.

Singular values below ``rcond`` x sigma_0 are dropped, so a rank-deficient
matrix returns fewer than k factors, as MLlib does. ``rcond`` defaults to the
method's own noise: sqrt(8 d eps) where A'A is formed, 8 d eps for ``tsqr``. Where
``auto`` finds fewer than k factors above the noise of A'A, ``tsqr`` tells the
small ones from round-off. Each column of V is sign-canonicalised: its
largest-magnitude entry is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks
from .moments import moments

GRAM_MAX_D = 4096
SQL_MAX_TERMS = 256
MAX_BASIS = 8                # blocks of a Krylov space before it is restarted
FAN_IN = 16                  # triangular factors folded by one task of the tree
DRIVER_FACTORS = 64 << 20    # bytes of factors that may meet on the driver


@dataclass
class SvdResult:
    sigma: np.ndarray    # r (r <= k)
    V: np.ndarray        # d x r
    method: str = "gram"
    converged: bool = True   # False: the iteration ran out of passes
    passes: int = 1          # over the data


def _canonical_signs(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for c in range(v.shape[1]):
        idx = int(np.argmax(np.abs(v[:, c])))
        if v[idx, c] < 0:
            v[:, c] = -v[:, c]
    return v


def _truncate(evals: np.ndarray, evecs: np.ndarray, k: int, rcond: float) -> SvdResult:
    order = np.argsort(evals)[::-1]
    evals, evecs = evals[order], evecs[:, order]
    sigma = np.sqrt(np.clip(evals, 0.0, None))
    if sigma.size == 0 or sigma[0] == 0.0:
        return SvdResult(np.zeros(0), np.zeros((evecs.shape[0], 0)))
    keep = 0
    while keep < min(k, sigma.size) and sigma[keep] >= rcond * sigma[0]:
        keep += 1
    return SvdResult(sigma[:keep], _canonical_signs(evecs[:, :keep]))


def truncated_svd(df: DataFrame, features: str, k: int, d: int, method: str = "auto",
                  rcond: float | None = None, oversample: int = 10, iterations: int = 100,
                  tol: float = 1e-10, seed: int = 0, persist: bool = True) -> SvdResult:
    """Rank-k right factors of the row matrix in ``features``.

    ``krylov`` stops once the residuals ||A'A v - λ v|| of the top k Ritz pairs are
    below ``tol`` x λ_max, or after ``iterations`` passes.

    ``subspace``: every pass gives Y = A'A Q, so the Ritz pairs of Q'Y and
    their true residuals ||A'A v - λ v|| = ||Y u - λ Q u|| come for free;
    iteration stops once the top k residuals are below ``tol`` x λ_max,
    or after ``iterations`` passes, and then says so in ``converged``."""
    auto = method == "auto"
    if auto:
        method = "gram" if d <= GRAM_MAX_D else "krylov"
    noise = 8 * d * np.finfo(float).eps
    if method == "tsqr":
        r = tall_skinny_r(df, features, d)
        _, sigma, vt = np.linalg.svd(r)
        return _cut(sigma, vt.T, k, noise if rcond is None else rcond, "tsqr")
    asked, rcond = rcond, max(rcond or 0.0, float(np.sqrt(noise)))
    if method == "gram":
        g = moments(df, features, d).xx
        evals, evecs = np.linalg.eigh(g)
        res = _truncate(evals, evecs, k, rcond)
        res.method = "gram"
        if auto and res.sigma.size < min(k, d) and (asked is None or asked < rcond):
            other = truncated_svd(df, features, k, d, "tsqr", asked)
            other.passes = 2
            return other
        return res
    if method == "krylov":
        return _krylov(df, features, k, d, rcond, oversample, iterations, tol, seed, persist)
    passes = blocks.persist_for_passes(df, [features], persist)
    try:
        width = min(d, k + oversample)
        src = blocks.prepare(passes.df, [features], d * width, partitions=passes.partitions)
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))
        converged = False
        for _ in range(iterations):
            y = blocks.gram_times(src, features, d, q)       # one pass
            b = q.T @ y
            evals, u = np.linalg.eigh((b + b.T) / 2.0)       # Rayleigh-Ritz on span(q)
            ritz = q @ u                                      # Ritz vectors of this pass
            top = np.argsort(evals)[::-1][:k]
            lam = evals[top]
            resid = np.linalg.norm(y @ u[:, top] - ritz[:, top] * lam, axis=0)
            converged = bool(np.all(resid <= tol * max(abs(lam[0]), np.finfo(float).tiny)))
            if converged:
                break
            q, _ = np.linalg.qr(y)
        res = _truncate(evals, ritz, k, rcond)
        res.method, res.converged = "subspace", converged
        return res
    finally:
        passes.release()


def _cut(sigma: np.ndarray, v: np.ndarray, k: int, rcond: float, method: str) -> SvdResult:
    keep = int((sigma[:k] > rcond * sigma[0]).sum()) if sigma.size and sigma[0] > 0 else 0
    return SvdResult(sigma[:keep], _canonical_signs(v[:, :keep]), method)


def _new_directions(block: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Orthonormal columns that add to ``basis`` what ``block`` has outside of it."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(s[0], 1.0)]
    return block


def _krylov(df, features, k, d, rcond, oversample, iterations, tol, seed, persist) -> SvdResult:
    width = min(d, k + oversample)
    passes = blocks.persist_for_passes(df, [features], persist)
    try:
        src = blocks.prepare(passes.df, [features], d * width, partitions=passes.partitions)
        basis, product = None, None
        block = _new_directions(np.random.default_rng(seed).standard_normal((d, width)), None)
        done, converged = 0, False
        while True:
            image = blocks.gram_times(src, features, d, block)           # one pass
            done += 1
            basis = block if basis is None else np.hstack([basis, block])
            product = image if product is None else np.hstack([product, image])
            b = basis.T @ product
            evals, u = np.linalg.eigh((b + b.T) / 2.0)
            u = u[:, ::-1][:, :width]
            lam = evals[::-1][:width]
            ritz, image = basis @ u, product @ u
            resid = image - ritz * lam
            size = np.linalg.norm(resid[:, :k], axis=0)
            converged = bool(np.all(size <= tol * max(abs(lam[0]), np.finfo(float).tiny)))
            block = _new_directions(resid, basis)
            if converged or not block.shape[1] or done >= iterations:
                converged = converged or not block.shape[1]              # the space is invariant
                break
            if basis.shape[1] + block.shape[1] > MAX_BASIS * width:
                basis, product = ritz, image
                block = _new_directions(resid, basis)
        res = _truncate(lam, ritz, k, rcond)
        res.method, res.converged, res.passes = "krylov", converged, done
        return res
    finally:
        passes.release()


def tall_skinny_r(df: DataFrame, features: str, d: int) -> np.ndarray:
    """Triangular R (at most d x d) with R'R = A'A, by Householder QR alone."""
    def fold(r, x):
        return np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")

    def batch(lane, r):
        yield pa.RecordBatch.from_pydict({"lane": pa.array([lane], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def local(batches):
        from pyspark import TaskContext
        r = None
        for b in batches:
            if b.num_rows:
                x = blocks.to_matrix(b.column(features), d, features)
                if not np.isfinite(x).all():
                    raise ValueError(f"{features}: values must be finite")
                r = fold(r, x)
        if r is not None:
            yield from batch(TaskContext.get().partitionId(), r)

    def merge(batches):
        r, lane = None, 0
        for b in batches:
            for lane, raw in zip(b.column("lane").to_pylist(), b.column("r").to_pylist(), strict=True):
                r = fold(r, np.frombuffer(raw).reshape(-1, d))
        if r is not None:
            yield from batch(lane, r)

    spark = df.sparkSession
    level = df.select(features).mapInArrow(local, "lane long, r binary")
    lanes = blocks.exchange_free_partitions(df.select(features)) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    while lanes * d * d * 8 > DRIVER_FACTORS:
        lanes = -(-lanes // FAN_IN)
        key = (F.col("lane") % lanes).cast("int").alias("lane")
        level = level.select(key, "r").repartition(lanes, "lane").mapInArrow(merge, "lane long, r binary")
        if lanes == 1:
            break
    r = np.zeros((0, d))
    for raw in sorted(bytes(x["r"]) for x in level.select("r").toLocalIterator()):
        r = fold(r, np.frombuffer(raw).reshape(-1, d))
    return r


def singular_values_frame(spark: SparkSession, res: SvdResult) -> DataFrame:
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(res.sigma)],
                                 "k_idx long, sigma double")


def right_vectors_frame(spark: SparkSession, res: SvdResult) -> DataFrame:
    v = res.V
    return spark.createDataFrame([(j, c, float(v[j, c])) for j in range(v.shape[0])
                                  for c in range(v.shape[1])], "j long, k_idx long, v double")


def _projection(v: np.ndarray) -> np.ndarray:
    return v @ v.T


def reconstruct(df: DataFrame, features: str, v: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """x_hat = V V' x per row as ``features_hat`` (array<double>)."""
    v = np.asarray(v, dtype=np.float64)
    d, r = v.shape
    keep = list(keep or [])
    if d * d <= SQL_MAX_TERMS:
        proj = _projection(v)
        return df.select(*keep, F.array(*[V.dot_const(features, proj[j]) for j in range(d)])
                         .alias("features_hat"))
    handle = blocks.ship(df.sparkSession, v)
    src = df.select(*keep, features)
    kept = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] +
                       ["features_hat array<double>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = blocks.to_matrix(b.column(features), d, features)
            vv = handle.value
            for lo, hi in blocks.row_chunks(x.shape[0], d):
                cols = {name: b.column(name).slice(lo, hi - lo) for name in keep}
                cols["features_hat"] = blocks.list_array((x[lo:hi] @ vv) @ vv.T)
                yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, schema)


def approximation_error(df: DataFrame, features: str, v: np.ndarray) -> DataFrame:
    """One pass: ``(err, fro_sq, relative_error)`` with
    err = Σ ||x - V V'x||², fro_sq = Σ ||x||²."""
    v = np.asarray(v, dtype=np.float64)
    d, r = v.shape
    if d * d <= SQL_MAX_TERMS:
        proj = _projection(v)
        x = F.col(features)
        resid = [x[j] - V.dot_const(features, proj[j]) for j in range(d)]
        agg = df.agg(F.sum(V.sum_columns([e * e for e in resid])).alias("err"),
                     F.sum(V.norm_sq(features, d)).alias("fro_sq"))
    else:
        handle = blocks.ship(df.sparkSession, v)

        def update(state, b):
            x = blocks.to_matrix(b.column(features), d, features)
            vv = handle.value
            res = x - (x @ vv) @ vv.T
            part = np.array([np.einsum("ij,ij->", res, res), np.einsum("ij,ij->", x, x)])
            return part if state is None else state + part

        parts = blocks.partial_sums(df, [features], update, lambda st: st, 2)
        agg = parts.agg(F.sum(F.when(F.col("idx") == 0, F.col("v"))).alias("err"),
                        F.sum(F.when(F.col("idx") == 1, F.col("v"))).alias("fro_sq"))
    return agg.select("err", "fro_sq",
                      F.when(F.col("fro_sq") == 0, F.lit(None).cast("double"))
                      .otherwise(F.col("err") / F.col("fro_sq")).alias("relative_error"))
