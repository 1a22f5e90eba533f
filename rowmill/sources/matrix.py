"""Row-matrix sources and sinks.

A matrix is a frame ``(id bigint, features array<double>)``; the stored form
is Parquet with an array column (or wide numeric columns). Row order is not
part of a Spark frame, so every "first N rows" operation names its order
column and runs as a bounded top-N (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partition_control(df: DataFrame, num_splits: int | None = None,
                      coalesce: bool = True) -> DataFrame:
    """``coalesce(n)`` (narrow, no shuffle; may give fewer partitions) or
    ``repartition(n)`` (full shuffle, exactly n). No-op unless n > 0."""
    if not num_splits or num_splits <= 0:
        return df
    return df.coalesce(num_splits) if coalesce else df.repartition(num_splits)


def read_matrix(spark: SparkSession, path: str, features: str | list[str],
                id_col: str | None = None, extra: list[str] | None = None,
                num_splits: int | None = None, coalesce: bool = True) -> DataFrame:
    """Parquet matrix -> ``(id, features array<double>, extra...)``.

    ``features`` is one numeric-array column or a list of numeric columns.
    Only the needed columns are read (pruned at the scan)."""
    raw = spark.read.parquet(path)
    if isinstance(features, str):
        feat = F.col(features).cast("array<double>")
    else:
        feat = F.array(*[F.col(c).cast("double") for c in features])
    cols = []
    if id_col:
        cols.append(F.col(id_col).cast("long").alias("id"))
    cols += [F.col(c) for c in (extra or [])]
    cols.append(feat.alias("features"))
    return partition_control(raw.select(*cols), num_splits, coalesce)


def to_long(df: DataFrame, features: str = "features", id_col: str = "id",
            value: str = "x") -> DataFrame:
    """Dense rows -> long form ``(id, j, x)`` (row-local, no shuffle)."""
    return df.select(F.col(id_col), F.posexplode(features).alias("j", value)).select(
        F.col(id_col), F.col("j").cast("long").alias("j"), F.col(value))


def head_rows(df: DataFrame, n: int, order_by: str = "id") -> DataFrame:
    """The first n rows in ``order_by`` order (a bounded top-n)."""
    return df.orderBy(order_by).limit(n)


def preview(df: DataFrame, n_rows: int = 101, n_cols: int = 10, order_by: str = "id",
            features: str = "features") -> DataFrame:
    """First ``n_rows`` rows, first ``n_cols`` columns."""
    return head_rows(df, n_rows, order_by).select(
        F.col(order_by), F.slice(F.col(features), 1, n_cols).alias(features))


def range_matrix(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Row i = [i*cols, ..., i*cols + cols - 1] (row-major arange)."""
    return spark.range(rows).select(
        F.col("id"),
        F.transform(F.sequence(F.lit(0), F.lit(cols - 1)),
                    lambda j: (F.col("id") * cols + j).cast("double")).alias("features"))


def write_matrix_csv(df: DataFrame, path: str, d: int, features: str = "features",
                     id_col: str | None = "id") -> None:
    """Headerless CSV, one matrix row per line (written by every task)."""
    cols = ([F.col(id_col)] if id_col else []) + [F.col(features)[j].alias(f"c{j}") for j in range(d)]
    df.select(*cols).write.mode("overwrite").option("header", "false").csv(path)


def read_matrix_csv(spark: SparkSession, path: str, d: int, with_id: bool = True) -> DataFrame:
    """Inverse of :func:`write_matrix_csv` with an explicit schema (no
    inference pass)."""
    fields = (["id long"] if with_id else []) + [f"c{j} double" for j in range(d)]
    raw = (spark.read.schema(", ".join(fields)).option("header", "false").option("mode", "FAILFAST")
           .csv(path))
    cols = ([F.col("id")] if with_id else []) + [
        F.array(*[F.col(f"c{j}") for j in range(d)]).alias("features")]
    return raw.select(*cols)


def write_label_pred(df: DataFrame, path: str, label: str = "label",
                     prediction: str = "prediction") -> None:
    """``label pred`` text lines, one pair per line, written by the tasks
    (nothing is collected to the driver)."""
    from ..functions.vectors import format_pair

    df.select(format_pair(label, prediction).alias("value")).write.mode("overwrite").text(path)


def read_label_pred(spark: SparkSession, path: str) -> DataFrame:
    """Reads pairs per line, or any number of pairs on one line (``l p l p ...``).
    A line with an odd number of values fails the query."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("v"))
    whole = F.when(F.size("v") % 2 == 0, F.size("v")).otherwise(F.raise_error(F.lit("odd number of values in a line")))
    return lines.select(F.explode(F.sequence(F.lit(0), whole - 2, F.lit(2))).alias("i"), "v").select(
        F.col("v")[F.col("i")].cast("int").alias("label"), F.col("v")[F.col("i") + 1].cast("int").alias("prediction"))
