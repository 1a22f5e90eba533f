"""k-means (Lloyd) with model-sized driver state.

Each iteration is one Spark job: every partition assigns its rows to the
nearest centre and emits per-cluster partial sums, counts and cost
(k·d + k + 1 values, packed 64 per row) that are summed across
partitions. A cluster
holding a third of all rows costs the same as any other: its rows never
leave their partition.

Semantics match MLlib's Lloyd step: ties go to the lowest cluster id, a
cluster that receives no rows keeps its previous centre, and iteration
stops after ``max_iter`` steps or when no centre moved more than
``epsilon`` (epsilon = 0 stops only at an exact fixed point).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .sparse import is_sparse


@dataclass
class KMeansResult:
    centers: np.ndarray
    cost_history: list = field(default_factory=list)
    iterations: int = 0
    converged: bool = False


def first_rows_init(df: DataFrame, features: str, k: int, order_by: str) -> np.ndarray:
    """Initial centres = the k rows with the smallest ``order_by`` values
    (a bounded top-k, executed as TakeOrderedAndProject)."""
    rows = df.orderBy(order_by).select(features).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"need at least k={k} rows, found {len(rows)}")
    if is_sparse(df, features):
        out = np.zeros((k, rows[0][0]["size"]))
        for c, (x,) in enumerate(rows):
            out[c, x["indices"]] = x["values"]
        return out
    return np.array([r[0] for r in rows], dtype=np.float64)


def kmeans_fit(df: DataFrame, features: str, k: int, d: int, max_iter: int = 20,
               init: str = "first", order_by: str | None = None,
               initial_centers=None, epsilon: float = 1e-4,
               seed: int = 42, persist: bool = True) -> KMeansResult:
    """Fit k centres.

    ``init``: 'first' (k smallest ``order_by`` rows), 'given'
    (``initial_centers``), 'k-means||' (:func:`parallel_init`), or 'random'
    (delegated to Spark ML's KMeans, which runs the same Lloyd steps in the JVM).
    """
    if init == "random":
        return _ml_kmeans(df, features, k, max_iter, init, epsilon, seed)
    if init == "given":
        centers = np.asarray(initial_centers, dtype=np.float64).reshape(k, d)
    elif init == "first":
        if order_by is None:
            raise ValueError("init='first' needs order_by: rows have no order otherwise")
        centers = first_rows_init(df, features, k, order_by)
    passes = blocks.persist_for_passes(df, [features], persist)
    try:
        if init == "k-means||":
            centers = parallel_init(passes.df, features, k, d, seed, passes.partitions)
        src = blocks.prepare(passes.df, [features], k * d + k + 1, partitions=passes.partitions)
        costs, converged, it = [], False, 0
        for it in range(1, max_iter + 1):
            sums, counts, cost = blocks.centroid_sums(src, features, d, centers)
            costs.append(cost)
            new = centers.copy()
            nonempty = counts > 0
            new[nonempty] = sums[nonempty] / counts[nonempty][:, None]
            moved = ((new - centers) ** 2).sum(axis=1).max()
            centers = new
            if moved <= epsilon * epsilon:
                converged = True
                break
        return KMeansResult(centers, costs, it, converged)
    finally:
        passes.release()


ROUNDS, OVERSAMPLE = 5, 2.0      # of k-means||: sampling passes, and candidates of each as a multiple of k


def parallel_init(df: DataFrame, features: str, k: int, d: int, seed: int = 42,
                  partitions: int | None = -1) -> np.ndarray:
    """k-means|| on rows of either form. Every pass keeps each row with probability
    ``OVERSAMPLE * k`` times its part of the cost; one more pass counts the rows
    nearest to each candidate, and weighted k-means++ picks k of them on the driver
    (about ``ROUNDS * OVERSAMPLE * k`` rows meet there, whatever the input)."""
    rng = np.random.default_rng(seed)
    row = df.where(F.col(features).isNotNull()).orderBy(F.xxhash64(F.col(features), F.lit(seed))).select(features).limit(1)
    centers = first_rows_init(row.withColumn("at", F.lit(0)), features, 1, "at")      # fails on an empty frame
    src = blocks.prepare(df, [features], ROUNDS * k * d, partitions=partitions)
    for turn in range(ROUNDS):
        _, _, cost = blocks.centroid_sums(src, features, d, centers)
        if cost <= 0:
            break
        handle = blocks.ship(df.sparkSession, centers)

        def sample(batches, handle=handle, cost=cost, turn=turn):
            from pyspark import TaskContext
            g = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = blocks.to_block(b.column(features), d, features)
                _, dist = blocks.nearest_center(x, handle.value)
                kept = np.flatnonzero(g.random(len(dist)) < OVERSAMPLE * k * dist / cost)
                if len(kept):
                    rows = [x[i:i + 1] for i in kept.tolist()]
                    dense = np.vstack([r if isinstance(r, np.ndarray) else r.dense() for r in rows])
                    yield pa.RecordBatch.from_arrays([blocks.list_array(dense)], names=["x"])

        got = src.df.mapInArrow(sample, "x array<double>").collect()
        blocks.release(handle)
        if got:
            centers = np.unique(np.vstack([centers, np.array([r["x"] for r in got])]), axis=0)
    _, weight, _ = blocks.centroid_sums(src, features, d, centers)
    return _weighted_plus_plus(centers, weight, k, rng)


def _weighted_plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ over weighted candidates, then Lloyd steps among them. Fewer distinct
    candidates than k: the last is repeated."""
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    near = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        odds = near * weight
        chosen.append(int(rng.choice(len(points), p=odds / odds.sum())) if odds.sum() > 0 else chosen[-1])
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centers = points[chosen].copy()
    for _ in range(30):
        arg, _ = blocks.nearest_center(points, centers)
        total = np.bincount(arg, weight, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, arg, points * weight[:, None])
        new = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centers)
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


def _ml_kmeans(df, features, k, max_iter, init, epsilon, seed) -> KMeansResult:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vec = df.select(array_to_vector(F.col(features)).alias("_v"))
    model = KMeans(k=k, maxIter=max_iter, tol=epsilon, seed=seed,
                   initMode="k-means||" if init == "k-means||" else "random",
                   featuresCol="_v").fit(vec)
    centers = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    summary = model.summary
    return KMeansResult(centers, [summary.trainingCost], summary.numIter, summary.numIter < max_iter)


def assign(df: DataFrame, features: str, centers, keep: list[str] | None = None,
           d: int | None = None) -> DataFrame:
    """Nearest-centre id per row (``prediction``) and its squared distance
    (``distance_sq``); rows stay in their partition (no shuffle)."""
    centers = np.asarray(centers, dtype=np.float64)
    k, dd = centers.shape
    keep = list(keep or [])
    handle = blocks.ship(df.sparkSession, centers)
    src = df.select(*keep, features)
    kept_fields = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields] +
                       ["prediction int", "distance_sq double"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = blocks.to_block(b.column(features), dd, features)
            arg, dist = blocks.nearest_center(x, handle.value)
            cols = {name: b.column(name) for name in keep}
            cols["prediction"] = pa.array(arg.astype(np.int32))
            cols["distance_sq"] = pa.array(dist)
            yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, schema)


def cost(df: DataFrame, features: str, centers) -> DataFrame:
    """Sum of squared distances to the nearest centre."""
    return assign(df, features, centers).agg(F.sum("distance_sq").alias("cost"))


def centers_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame(
        [(c, j, float(centers[c, j])) for c in range(centers.shape[0])
         for j in range(centers.shape[1])], "cluster long, j long, center double")
