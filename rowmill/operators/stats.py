"""Global statistics over a feature frame (one pass each, partial
aggregation map-side, a single-row or d-row result).

Canonical frame: ``(id, label, features array<double>)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks

# Up to this dimension the per-feature statistics are one row of d
# aggregate columns (codegen); above it every task reduces its rows to one
# row of vectors (count, means, squared deviations, largest magnitudes).
WIDE_D = 64


def dims(df: DataFrame, features: str = "features") -> DataFrame:
    """Row count and row-length range in one scan: ``(n, d_min, d_max)``."""
    size = F.size(F.col(features))
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.min(size).cast("long").alias("d_min"),
                  F.max(size).cast("long").alias("d_max"))


def require_dims(df: DataFrame, features: str = "features") -> tuple[int, int]:
    """(n, d), failing clearly when rows disagree in length."""
    row = dims(df, features).first()
    n, dmin, dmax = int(row["n"]), row["d_min"], row["d_max"]
    if n == 0:
        raise ValueError("empty matrix")
    if dmin != dmax:
        raise ValueError(f"{features}: rows of unequal length ({dmin}..{dmax})")
    return n, int(dmin)


def label_mean(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("label_mean"))


def _wide_partials(df: DataFrame, features: str, d: int, label: str | None = None) -> DataFrame:
    """One row per task: ``(n, y_mean, mean[d], m2[d], top[d])``, merged batch by
    batch, so no element is exploded and no digits are lost."""
    import pyarrow as pa

    columns = [features] + ([label] if label else [])

    def run(batches):
        n, y_mean = 0, 0.0
        mean, m2, top = np.zeros(d), np.zeros(d), np.zeros(d)
        for b in batches:
            if not b.num_rows:
                continue
            x = blocks.to_matrix(b.column(features), d, features)
            k = len(x)
            mu = x.mean(axis=0)
            gap = mu - mean
            m2 += ((x - mu) ** 2).sum(axis=0) + gap * gap * (n * k / (n + k))
            mean += gap * (k / (n + k))
            top = np.maximum(top, np.abs(x).max(axis=0))
            if label:
                y_mean += (blocks.to_vector(b.column(label), label).mean() - y_mean) * (k / (n + k))
            n += k
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([y_mean], pa.float64())]
                + [blocks.list_array(v[None, :]) for v in (mean, m2, top)],
                names=["n", "y_mean", "mean", "m2", "top"])

    return df.select(*columns).mapInArrow(
        run, "n long, y_mean double, mean array<double>, m2 array<double>, top array<double>")


def _by_feature(partials: DataFrame) -> DataFrame:
    """``(j, n, y_mean, max_abs, var_pop)`` from the tasks' rows (tasks x d values)."""
    long = partials.select("n", "y_mean", F.posexplode(F.arrays_zip("mean", "m2", "top")).alias("j", "s")).select(
        "n", "y_mean", F.col("j").cast("long").alias("j"), "s.mean", "s.m2", "s.top")
    n, shift = F.sum("n"), F.min("mean")
    of = long.groupBy("j").agg(
        n.alias("n"), (F.sum(F.col("n") * F.col("y_mean")) / n).alias("y_mean"), F.max("top").alias("max_abs"),
        F.sum("m2").alias("within"), shift.alias("base"),
        F.collect_list(F.struct("n", "mean")).alias("parts"))              # one entry per task
    away = lambda power: F.aggregate(  # noqa: E731 - moments of the task means around one of them
        "parts", F.lit(0.0), lambda a, p: a + p["n"] * F.pow(p["mean"] - F.col("base"), F.lit(float(power))))
    between = away(2) - away(1) * away(1) / F.col("n")
    return of.select("j", "n", "y_mean", "max_abs",
                     ((F.col("within") + F.greatest(between, F.lit(0.0))) / F.col("n")).alias("var_pop"))


def feature_max_abs(df: DataFrame, features: str = "features", d: int | None = None) -> DataFrame:
    """Per-feature max |x_ij| as ``(j, max_abs)``."""
    if d is not None and d <= WIDE_D:
        row = df.agg(*[F.max(F.abs(F.col(features)[j])).alias(f"m{j}") for j in range(d)])
        return row.select(F.explode(F.array(*[
            F.struct(F.lit(j).cast("long").alias("j"), F.col(f"m{j}").alias("max_abs"))
            for j in range(d)])).alias("s")).select("s.*")
    if d is None:
        _, d = require_dims(df, features)
    return _by_feature(_wide_partials(df, features, d)).select("j", "max_abs")


@dataclass
class ScaleStats:
    label_mean: float
    max_abs: list[float]


def scale_stats(df: DataFrame, label: str, features: str, d: int) -> ScaleStats:
    """Mean label and per-feature max |x| in one aggregate."""
    if d <= WIDE_D:
        row = df.agg(F.avg(F.col(label).cast("double")).alias("mu"),
                     F.sum(F.when(V.is_row(features, d) & F.col(label).isNotNull(), 0).otherwise(1)).alias("bad"),
                     *[F.max(F.abs(F.col(features)[j])).alias(f"m{j}") for j in range(d)]).first()
        if row["bad"]:
            raise ValueError(f"{row['bad']} rows are null, of a length other than {d}, or have a null element or label")
        if row["mu"] is None:
            raise ValueError("empty matrix")
        return ScaleStats(float(row["mu"]), [float(row[f"m{j}"]) for j in range(d)])
    rows = _by_feature(_wide_partials(df, features, d, label)).orderBy("j").collect()      # d rows
    if not rows:
        raise ValueError("empty matrix")
    return ScaleStats(float(rows[0]["y_mean"]), [float(r["max_abs"]) for r in rows])


def sparse_scale_stats(df: DataFrame, label: str, features: str, d: int) -> ScaleStats:
    """:func:`scale_stats` of sparse rows: stored values are exploded and their
    maxima combined before the shuffle; features never stored have maximum 0."""
    x = F.col(features)
    row = df.agg(F.avg(F.col(label).cast("double")).alias("mu"), F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(x.isNull() | F.col(label).isNull() | (x["size"] != d), 1).otherwise(0)).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows are null, of a length other than {d}, or have a null element or label")
    if not row["n"]:
        raise ValueError("empty matrix")
    stored = df.select(F.explode(F.arrays_zip(x["indices"].alias("j"), x["values"].alias("v"))).alias("e"))
    top = np.zeros(d)
    for j, v in stored.groupBy(F.col("e.j").alias("j")).agg(F.max(F.abs("e.v")).alias("m")).collect():     # d rows at most
        top[j] = v
    return ScaleStats(float(row["mu"]), top.tolist())


def center_maxabs_scale(df: DataFrame, label: str = "label", features: str = "features",
                        d: int | None = None, stats: ScaleStats | None = None,
                        keep: list[str] | None = None) -> tuple[DataFrame, ScaleStats]:
    """``(y - mean(y), x_j / max_i |x_ij|)``; an all-zero feature stays 0.0."""
    if d is None:
        _, d = require_dims(df, features)
    stats = stats or scale_stats(df, label, features, d)
    out = df.select(*(keep or []),
                    (F.col(label).cast("double") - F.lit(stats.label_mean)).alias(label),
                    V.scale_by(features, stats.max_abs).alias(features))
    return out, stats


def row_norm_sq(df: DataFrame, features: str = "features", d: int | None = None,
                keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), V.norm_sq(features, d).alias("norm_sq"))


def frobenius_norm_sq(df: DataFrame, features: str = "features", d: int | None = None) -> DataFrame:
    return df.agg(F.sum(V.norm_sq(features, d)).alias("fro_sq"))


def rbf_bandwidth(df: DataFrame, features: str = "features", d: int | None = None,
                  by: str | None = None, first_rows: int | None = None,
                  order_by: str | None = None) -> DataFrame:
    """Mean squared pairwise distance over all ordered pairs (self-pairs
    included) and its square root, without forming pairs:
    mean_{i,j} ||x_i - x_j||^2 = 2 * sum_j var_pop(x_.j).

    With ``by`` (a block column) the mean is taken within each block and
    the block means are averaged unweighted, the way the original averaged
    its per-partition estimates; blocks never form pairs either.
    ``first_rows`` (with ``order_by``) keeps only the first N rows of each
    block (of the whole frame without ``by``), as the original estimated
    from at most 500 rows per partition. That is a per-group top-N, which
    Spark limits map-side before any shuffle."""
    keys = [by] if by else []
    if first_rows is not None:
        if order_by is None:
            raise ValueError("first_rows needs order_by (rows have no order otherwise)")
        from pyspark.sql import Window
        w = Window.partitionBy(*keys).orderBy(order_by) if keys else Window.orderBy(order_by)
        if keys:
            df = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first_rows)
        else:
            df = df.orderBy(order_by).limit(first_rows)
    if d is not None and d <= WIDE_D:
        total = V.sum_columns([F.var_pop(F.col(features)[j]) for j in range(d)])
        agg = df.groupBy(*keys).agg((F.lit(2.0) * total).alias("sigma_sq"))
    elif not keys:
        if d is None:
            _, d = require_dims(df, features)
        agg = _by_feature(_wide_partials(df, features, d)).agg((F.lit(2.0) * F.sum("var_pop")).alias("sigma_sq"))
    else:
        agg = (df.select(*keys, F.posexplode(features).alias("j", "x"))
               .groupBy(*keys, "j").agg(F.var_pop("x").alias("v"))
               .groupBy(*keys).agg((F.lit(2.0) * F.sum("v")).alias("sigma_sq")))
    if by:
        agg = agg.agg(F.avg("sigma_sq").alias("sigma_sq"))
    return agg.select("sigma_sq", F.sqrt("sigma_sq").alias("sigma"))


PAIR_ROWS = 500              # rows of a block whose pairs are taken, as in the bandwidth's definition


def pairwise_sqdist(df: DataFrame, block: str, id_col: str = "id", features: str = "features", d: int | None = None,
                    rows: int = PAIR_ROWS) -> DataFrame:
    """``(block, a, b, sqdist)``: squared distances of all pairs of the first ``rows``
    rows of each block in order of id, each row with itself included. A block's rows are
    limited before they are shuffled; its pairs come from one kernel call."""
    if d is None:
        _, d = require_dims(df, features)
    first = Window.partitionBy("block").orderBy("id")
    some = (df.select(F.col(block).alias("block"), F.col(id_col).cast("long").alias("id"), F.col(features).alias("x"))
            .withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows))
    kind = some.schema["block"].dataType.simpleString()

    def pairs(table: pa.Table) -> pa.Table:
        x = blocks.to_matrix(table.column("x"), d, features)
        ids = table.column("id").to_numpy()
        out = np.empty((len(ids), len(ids)))
        for i in range(len(ids)):
            diff = x - x[i]
            out[i] = np.einsum("ij,ij->i", diff, diff)
        n = len(ids)
        return pa.table({"block": table.column("block").take(pa.array(np.zeros(n * n, np.int64))),
                         "a": np.repeat(ids, n), "b": np.tile(ids, n), "sqdist": out.reshape(-1)})

    return some.groupBy("block").applyInArrow(pairs, f"block {kind}, a long, b long, sqdist double")


def bandwidth_value(df: DataFrame, features: str = "features", d: int | None = None,
                    by: str | None = None) -> float:
    return float(rbf_bandwidth(df, features, d, by).first()["sigma"])


__all__ = ["dims", "require_dims", "label_mean", "feature_max_abs", "scale_stats",
           "center_maxabs_scale", "row_norm_sq", "frobenius_norm_sq", "rbf_bandwidth",
           "bandwidth_value", "ScaleStats"]
