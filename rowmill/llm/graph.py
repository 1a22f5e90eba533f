"""Connected components of an edge table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(id, comp)`` for every id of ``edges (a, b)``: the smallest id it reaches.

    Each pass takes the smallest label among the neighbours, then the label of
    that label (pointer jumping), until no label changes; every pass is written
    to the shared folder. Labels are pre-aggregated before each shuffle, so one
    node with very many neighbours stays cheap.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                     .select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
                .agg(F.min("comp").alias("m")))
        # both sides of the joins are tables, so that the partition of a large component or a hub can be split
        step = written(labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp")),
                       "step")
        jump = written(step.select("comp").distinct().join(step.select(F.col("id").alias("comp"), F.col("comp").alias("next")),
                                                           "comp"), "jump")
        new = written(step.join(jump, "comp", "left")
                      .select("id", "was", F.coalesce("next", "comp").alias("comp")), "labels")
        labels = new.select("id", "comp")
        if new.where("was <> comp").isEmpty():
            return labels
