"""Normalized mutual information of two labelings (clustering score).

Plan: the contingency table ``groupBy(u, v).count()`` (partial aggregation
map-side, so a dominant label costs nothing extra), both marginals by a
second partial aggregation of its rows, and one final aggregate over the
three count lists; no window or sort, so one label against very many
predictions is summed map-side too. With
N = Σ n_uv, S = Σ n_uv ln n_uv, Su = Σ n_u ln n_u, Sv = Σ n_v ln n_v:

    MI = (S - Su - Sv)/N + ln N,  H_u = ln N - Su/N,  H_v = ln N - Sv/N

Both normalisers are reported: geometric MI/sqrt(H_u H_v) and arithmetic
2·MI/(H_u + H_v). Limits: both labelings constant -> 1.0; MI = 0 -> 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count(F.lit(1)).alias("n_uv"))


def nmi(df: DataFrame, u: str = "label", v: str = "prediction") -> DataFrame:
    cont = contingency(df, u, v)
    counts = (cont.select(F.lit("uv").alias("of"), F.col("n_uv").alias("c"))
              .union(cont.groupBy("u").agg(F.sum("n_uv").alias("c")).select(F.lit("u"), "c"))
              .union(cont.groupBy("v").agg(F.sum("n_uv").alias("c")).select(F.lit("v"), "c")))
    ln = F.log
    of, term = F.col("of"), F.col("c") * ln("c")
    agg = counts.agg(
        F.sum(F.when(of == "uv", F.col("c"))).cast("double").alias("N"),
        F.sum(F.when(of == "uv", term)).alias("S"),
        F.sum(F.when(of == "u", term)).alias("Su"),
        F.sum(F.when(of == "v", term)).alias("Sv"),
        F.max(F.when(of == "u", F.col("c"))).alias("max_u"),
        F.max(F.when(of == "v", F.col("c"))).alias("max_v"))
    mi = (F.col("S") - F.col("Su") - F.col("Sv")) / F.col("N") + ln("N")
    hu = ln("N") - F.col("Su") / F.col("N")
    hv = ln("N") - F.col("Sv") / F.col("N")
    # a labeling with a single value (its one marginal holds all N rows) has
    # exactly zero entropy
    base = agg.select(F.greatest(mi, F.lit(0.0)).alias("mi"),
                      F.when(F.col("max_u") == F.col("N"), F.lit(0.0)).otherwise(hu).alias("h_u"),
                      F.when(F.col("max_v") == F.col("N"), F.lit(0.0)).otherwise(hv).alias("h_v"))

    def normalised(denominator):
        return (F.when((F.col("h_u") == 0) & (F.col("h_v") == 0), F.lit(1.0))
                .when((F.col("mi") == 0) | (F.col("h_u") == 0) | (F.col("h_v") == 0), F.lit(0.0))
                .otherwise(F.col("mi") / denominator))

    return base.select(
        "mi", "h_u", "h_v",
        normalised(F.sqrt(F.col("h_u") * F.col("h_v"))).alias("nmi_geometric"),
        normalised((F.col("h_u") + F.col("h_v")) / F.lit(2.0)).alias("nmi_arithmetic"))
