"""Distributed moments: X'y (cross moment), X'X (Gram) and matrix-free
Gram products X'X P.

Two physical paths, same results:

* ``sql``: d(d+1)/2 + d·k sum columns in one aggregate over ``features[i]``
  (whole-stage codegen, one partial row per task). Chosen for small d.
* ``arrow``: per-partition numpy blocks (see :mod:`blocks`) emitted as a
  flat partial vector, 64 values per row, summed across partitions.
  Chosen for wide rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks
from .blocks import Moments
from .sparse import is_sparse

SQL_MAX_D = 16
# The sql path is one aggregate with this many sum columns at most.
SQL_MAX_AGGS = 400


def _pick(method: str, d: int, k: int = 1) -> str:
    if method == "auto":
        aggs = d * (d + 1) // 2 + d * k + k
        return "sql" if d <= SQL_MAX_D and aggs <= SQL_MAX_AGGS else "arrow"
    return method


def _label_terms(label: str, label_kind: str, k: int, c: int):
    y = F.col(label)
    if label_kind == "scalar":
        return y.cast("double")
    if label_kind == "class":
        return F.when(y.cast("int") == c, F.lit(1.0)).otherwise(F.lit(0.0))
    return y[c]


def moments(df: DataFrame, features: str, d: int, label: str | None = None,
            k: int = 1, label_kind: str = "scalar", method: str = "auto",
            rows: blocks.RowMap | None = None) -> Moments:
    """X'X, X'Y, diag(Y'Y) and n, collected to the driver (model-sized); of the
    mapped rows when there is a row map."""
    if rows is not None or is_sparse(df, features) or _pick(method, d, k if label is not None else 0) == "arrow":
        parts = blocks.normal_equation_partials(df, features, d, label, k, label_kind, rows=rows)
        return blocks.collect_moments(parts, d, k, with_label=label is not None)
    x = F.col(features)
    aggs = [F.count(F.lit(1)).alias("n"), _bad_rows(features, d, label).alias("bad_rows")]
    for i in range(d):
        for j in range(i, d):
            aggs.append(F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}"))
    if label is not None:
        if label_kind == "class":
            lab = F.col(label).cast("int")
            aggs.append(F.sum(F.when((lab < 0) | (lab >= k), 1).otherwise(0)).alias("bad"))
        for c in range(k):
            yc = _label_terms(label, label_kind, k, c)
            aggs.append(F.sum(yc * yc).alias(f"yy_{c}"))
            for i in range(d):
                aggs.append(F.sum(x[i] * yc).alias(f"xy_{i}_{c}"))
    row = df.agg(*aggs).first()
    if row["bad_rows"]:
        raise ValueError(f"{row['bad_rows']} rows are null, of a length other than {d}, or have a null element or label")
    if label is not None and label_kind == "class" and row["bad"]:
        raise ValueError(f"class id out of range [0,{k}) in {row['bad']} rows")
    xx = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            xx[i, j] = xx[j, i] = row[f"xx_{i}_{j}"] or 0.0
    xy = yy = None
    if label is not None:
        xy = np.array([[row[f"xy_{i}_{c}"] or 0.0 for c in range(k)] for i in range(d)])
        yy = np.array([row[f"yy_{c}"] or 0.0 for c in range(k)])
    return Moments(n=float(row["n"]), xx=xx, xy=xy, yy=yy)


def _bad_rows(features: str, d: int, label: str | None = None):
    """Rows that the Arrow path refuses, counted in the same scan."""
    ok = V.is_row(features, d)
    if label is not None:
        ok = ok & F.col(label).isNotNull()
    return F.coalesce(F.sum(F.when(ok, 0).otherwise(1)), F.lit(0))


def _checked(row: DataFrame, d: int) -> DataFrame:
    """The aggregate row, or a failure if it counted bad rows."""
    first = row.columns[0]
    return row.withColumn(first, F.when(F.col("bad_rows") == 0, F.col(first)).otherwise(
        F.raise_error(F.lit(f"rows are null, of a length other than {d}, or have a null element or label"))))


def gram_matrix(df: DataFrame, features: str, d: int, method: str = "auto") -> DataFrame:
    """Full X'X in long form ``(i, j, g)``, lazily (no driver round trip)."""
    if _pick(method, d) == "arrow":
        cells = blocks.flat_values(blocks.gram_full_partials(df, features, d), d * d)
        return cells.select(F.expr(f"idx div {d}").alias("i"),
                            (F.col("idx") % d).cast("long").alias("j"), F.col("v").alias("g"))
    x = F.col(features)
    row = _checked(df.agg(*[F.sum(x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(d) for j in range(i, d)],
                          _bad_rows(features, d).alias("bad_rows")), d)
    cells = []
    for i in range(d):
        for j in range(d):
            a, b = min(i, j), max(i, j)
            cells.append(F.struct(F.lit(i).cast("long").alias("i"),
                                  F.lit(j).cast("long").alias("j"),
                                  F.col(f"g_{a}_{b}").alias("g")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def cross_moment(df: DataFrame, features: str, label: str, d: int,
                 method: str = "auto") -> DataFrame:
    """X'y in long form ``(j, xy)``."""
    if _pick(method, d) == "arrow":
        parts = blocks.normal_equation_partials(df, features, d, label, 1, "scalar",
                                                with_xx=False)
        cells = blocks.flat_values(parts, blocks.normal_equation_length(d, 1, True, False))
        return cells.filter(F.col("idx") < d).select(F.col("idx").alias("j"), F.col("v").alias("xy"))
    x, y = F.col(features), F.col(label).cast("double")
    row = _checked(df.agg(*[F.sum(x[j] * y).alias(f"xy{j}") for j in range(d)],
                          _bad_rows(features, d, label).alias("bad_rows")), d)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(j).cast("long").alias("j"), F.col(f"xy{j}").alias("xy"))
        for j in range(d)])).alias("c")).select("c.*")


def gram_vector_product(df: DataFrame, features: str, d: int, p) -> DataFrame:
    """Matrix-free X'X p in long form ``(j, v)`` (one pass, p shipped)."""
    p = np.asarray(p, dtype=np.float64).reshape(d, 1)
    cells = blocks.flat_values(blocks.gram_times_partials(df, features, d, p), d)
    return cells.select(F.col("idx").alias("j"), "v")


__all__ = ["moments", "gram_matrix", "cross_moment", "gram_vector_product", "Moments"]
