"""Labelled CSV (A3): headerless, all columns numeric; column 0 holds a
1-based class, the rest are features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .matrix import partition_control


def read_labeled_csv(spark: SparkSession, path: str, d: int | None = None,
                     num_splits: int | None = None, coalesce: bool = True) -> DataFrame:
    """``(label int, features array<double>)`` with label = class - 1.

    ``d`` is the feature count; without it the first line gives the width. A
    malformed or missing number and a line of another width fail the query."""
    if d is None:
        d = len(spark.read.option("header", "false").csv(path).columns) - 1
        if d < 0:
            raise ValueError(f"{path}: no lines, so the width is not known; pass d")
    schema = ", ".join(["c0 double"] + [f"c{j + 1} double" for j in range(d)])
    raw = spark.read.schema(schema).option("header", "false").option("mode", "FAILFAST").csv(path)
    cols = [F.col(f"c{j + 1}") for j in range(d)]
    raw = partition_control(raw, num_splits, coalesce)
    first = V.required(F.col("c0"), None, "missing class in a CSV line")
    return raw.select(V.class_shift(first).alias("label"),
                      V.required(F.array(*cols), V.is_row(F.array(*cols), len(cols)),
                                 "missing number in a CSV line").alias("features"))


def write_labeled_csv(df: DataFrame, path: str, d: int, label: str = "label",
                      features: str = "features", one_based: bool = True) -> None:
    lab = F.col(label).cast("int") + (1 if one_based else 0)
    df.select(lab.alias("c0"), *[F.col(features)[j].alias(f"c{j + 1}") for j in range(d)]) \
        .write.mode("overwrite").option("header", "false").csv(path)
