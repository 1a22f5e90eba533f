"""Spark-side helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, StructType

from rowmill import session
from rowmill.session import scratch_path

NULL_ID = -(2 ** 63)
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Package to the executors, and batches of whole texts bounded: at most 1,000
    rows, and ``BATCH_BYTES`` where the session names no limit of its own."""
    session.ship_package(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= 1000:
        spark.conf.set(rows, "1000")
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut
    and the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_of(name: str) -> Column:
    """Document id as a join key; a null id is a document of its own, below all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row): the row keeps all other columns, whatever their names.
    Ids must be integers."""
    names = docs.columns
    kind = docs.schema.fields[names.index(id_col)].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise ValueError(f"{id_col}: ids must be integers, not {kind.simpleString()}")
    flat = docs.toDF(*[f"c{k}" for k in range(len(names))])      # names may clash but for their case
    cols = [F.col(f"c{k}").alias(c) for k, c in enumerate(names) if k != names.index(text_col)]
    return flat.select(key_of(f"c{names.index(id_col)}").alias("id"),
                       F.col(f"c{names.index(text_col)}").cast("string").alias("text"), F.struct(*cols).alias("row"))


def with_row(df: DataFrame, columns: str) -> StructType:
    """Schema of ``row`` as it is in ``df``, and more columns."""
    return StructType([df.schema["row"], *StructType.fromDDL(columns).fields])
