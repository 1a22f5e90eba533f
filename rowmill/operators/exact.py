"""Sums that do not depend on partitions, batches or the order of rows.

A double is an integer of 53 bits times a power of two. A partial holds, for every
sum, integers in bins of ``STEP`` exponents; adding a value adds two pieces of its
integer to their bins, and bins are carried on after each batch so that none
overflows. Partials are added as 64-bit integers, which is exact in any order; the
driver turns the bins of a sum into the nearest double. The result is the exact sum
of the addends, rounded once: bit-equal for any partitioning, and after a lost task.

What is exact is the sum: an addend is the double that its column expression gives.
Null, NaN and infinite addends fail, as in the other kernels.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ridge import residual_sq

STEP = 16
LOWEST = -1074 - 53                                  # exponent of bin 0
BINS = (1024 - LOWEST) // STEP + 4
LOW_BITS = 26
RENORM_ROWS = 1 << 18                                # 2^18 addends of under 2^43 stay under 2^62


def _add(bins: np.ndarray, values: np.ndarray) -> None:
    """bins += values, one sum of integers; ``values`` are finite doubles."""
    mantissa, exponent = np.frexp(values)
    whole = (mantissa * 9007199254740992.0).astype(np.int64)          # 53 bits, exactly
    low = whole & ((1 << LOW_BITS) - 1)
    for part, at in ((low, exponent - 53 - LOWEST), ((whole - low) >> LOW_BITS, exponent - 53 + LOW_BITS - LOWEST)):
        np.add.at(bins, at // STEP, part << (at % STEP).astype(np.int64))


def _carry(bins: np.ndarray) -> None:
    """Every bin but the last in [0, 2^STEP), the value unchanged."""
    for k in range(bins.shape[-1] - 1):
        up = bins[..., k] >> STEP
        bins[..., k] -= up << STEP
        bins[..., k + 1] += up


def total(bins: dict[int, int]) -> float:
    """The double nearest to the sum of bins."""
    whole = sum(int(v) << (STEP * k) for k, v in bins.items())
    return float(Fraction(whole) * (Fraction(2) ** LOWEST)) if whole else 0.0


def exact_sums(df: DataFrame, *columns: Column) -> list[float]:
    """The exact sum of each column, rounded once; 0.0 without rows. One pass; the
    shuffle carries at most ``BINS`` integers a task and sum."""
    names = [f"s{k}" for k in range(len(columns))]
    src = df.select(*[c.cast("double").alias(n) for n, c in zip(names, columns, strict=True)])

    def run(batches):
        bins = np.zeros((len(names), BINS), np.int64)
        for b in batches:
            for k, n in enumerate(names):
                col = b.column(n)
                if col.null_count:
                    raise ValueError("exact sum of a null")
                v = col.to_numpy(zero_copy_only=False)
                if not np.isfinite(v).all():
                    raise ValueError("exact sum of a value that is not finite")
                for a in range(0, len(v), RENORM_ROWS):
                    _add(bins[k], v[a:a + RENORM_ROWS])
                    _carry(bins[k])
        k, at = np.nonzero(bins)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "bin": pa.array(at, pa.int32()),
                                          "v": pa.array(bins[k, at], pa.int64())})

    rows = src.mapInArrow(run, "k int, bin int, v long").groupBy("k", "bin").agg(F.sum("v").alias("v")).collect()
    held: list[dict[int, int]] = [{} for _ in names]
    for r in rows:                                   # at most BINS rows a sum
        held[r["k"]][r["bin"]] = r["v"]
    return [total(h) for h in held]


# ---------------------------------------------------------------------------
# Statistics over exact sums (C2, C6-C10 and the clustering cost)
# ---------------------------------------------------------------------------

def _one(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{c} double" for c in values))


def label_mean(df: DataFrame, label: str = "label") -> DataFrame:
    """``label_mean``; null without rows."""
    n, s = exact_sums(df, F.lit(1.0), F.col(label))
    return _one(df, {"label_mean": s / n if n else None})


def frobenius_norm_sq(df: DataFrame, features: str = "features", d: int | None = None) -> DataFrame:
    return _one(df, {"fro_sq": exact_sums(df, V.norm_sq(features, d))[0]})


def ridge_objective(df: DataFrame, features: str, label: str, w, gamma: float) -> DataFrame:
    """``(train_error, objective)`` at w, as :func:`ridge.ridge_objective`."""
    n, sse = exact_sums(df, F.lit(1.0), residual_sq(features, label, w))
    wn = float(np.dot(w, w))
    return _one(df, {"train_error": sse / n if n else None, "objective": (sse + n * gamma * wn) / (2.0 * n) if n else None})


def linear_mse(df: DataFrame, features: str, label: str, w) -> DataFrame:
    n, sse = exact_sums(df, F.lit(1.0), residual_sq(features, label, w))
    return _one(df, {"mse": sse / n if n else None})


def ridge_gradient(df: DataFrame, features: str, label: str, w, gamma: float) -> DataFrame:
    """``(j, grad)``: X'(Xw - y) + nγw."""
    r = V.dot_const(features, w) - V.required(F.col(label).cast("double"), None, "label is null")
    rows = df.select(F.col(features).alias("x"), r.alias("r"))
    n, *g = exact_sums(rows, F.lit(1.0), *[F.col("x")[j] * F.col("r") for j in range(len(w))])
    return df.sparkSession.createDataFrame([(j, v + n * (gamma * float(w[j]))) for j, v in enumerate(g)], "j long, grad double")


def kmeans_cost(df: DataFrame, features: str, centers) -> DataFrame:
    from .kmeans import assign

    return _one(df, {"cost": exact_sums(assign(df, features, centers), F.col("distance_sq"))[0]})
