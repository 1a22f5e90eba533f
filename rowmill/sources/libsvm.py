"""libsvm text: Spark's libsvm source (A1), a text-line parser job (A2)
and a distributed writer.

Label casts (all three exist in the original loaders):
``'double'`` (text -> double), ``'float_double'`` (text -> float ->
double) and ``'float_int'`` (text -> float -> int, truncating).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .matrix import partition_control


def _cast_label(col, label_cast: str):
    if label_cast == "double":
        return col.cast("double")
    if label_cast == "float_double":
        return col.cast("float").cast("double")
    if label_cast == "float_int":
        return col.cast("float").cast("int")
    raise ValueError(f"unknown label_cast {label_cast!r}")


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None,
                label_cast: str = "double", num_splits: int | None = None,
                coalesce: bool = True) -> DataFrame:
    """(label, features array<double>) via Spark's libsvm source, which
    shifts the 1-based file index to 0-based. Pass ``num_features``: without
    it the source makes an extra pass over the data to find it."""
    from pyspark.ml.functions import vector_to_array

    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", str(num_features))
    raw = reader.load(path)
    raw = partition_control(raw, num_splits, coalesce)
    return raw.select(_cast_label(F.col("label"), label_cast).alias("label"),
                      vector_to_array(F.col("features")).alias("features"))


def read_libsvm_sparse(spark: SparkSession, path: str, num_features: int | None = None,
                       label_cast: str = "double", num_splits: int | None = None,
                       coalesce: bool = True) -> DataFrame:
    """(label, features struct<size, indices, values>): the stored entries alone, with
    0-based indices, parsed by column expressions. No row is made dense. Without
    ``num_features`` one more pass finds the largest index. Malformed entries fail."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    tokens = F.split(F.trim("value"), r"\s+")
    entries = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.split(t, ":"))
    raw = lines.select(tokens[0].alias("label"), F.transform(entries, lambda e: e[0].cast("int") - 1).alias("indices"),
                       F.transform(entries, lambda e: e[1].cast("double")).alias("values"))
    if num_features is None:
        num_features = (raw.agg(F.max(F.array_max("indices"))).first()[0] or 0) + 1
    raw = partition_control(raw, num_splits, coalesce)
    return raw.select(_cast_label(F.col("label"), label_cast).alias("label"),
                      F.struct(F.lit(num_features).cast("int").alias("size"), "indices", "values").alias("features"))


def format_libsvm(df: DataFrame, label: str, sparse: str) -> DataFrame:
    """One ``value`` text line per row: ``label i:x ...`` with 1-based,
    ascending indices, nonzero entries only. ``sparse`` is a map<int,double>
    row or a dense numeric array."""
    from pyspark.sql.types import ArrayType

    if isinstance(df.schema[sparse].dataType, ArrayType):
        entries = F.transform(F.col(sparse), lambda x, i: F.struct(
            i.alias("key"), x.cast("double").alias("value")))
    else:
        entries = F.array_sort(F.map_entries(F.col(sparse)))
    nonzero = F.filter(entries, lambda e: e["value"] != 0)
    tokens = F.transform(nonzero, lambda e: F.concat(
        (e["key"] + 1).cast("string"), F.lit(":"), e["value"].cast("string")))
    return df.select(F.concat_ws(" ", F.col(label).cast("string"),
                                 F.array_join(tokens, " ")).alias("value"))


def write_libsvm(df: DataFrame, label: str, sparse: str, path: str) -> None:
    """Distributed sink: every task writes its own part file."""
    format_libsvm(df, label, sparse).write.mode("overwrite").text(path)


def parse_libsvm_lines(lines: DataFrame, index_base: int = 0, d: int | None = None,
                       column: str = "value") -> DataFrame:
    """Parse libsvm lines into ``(label double, features map<int,double>)``.

    ``index_base`` is subtracted from every file index: 0 keeps the index
    as written (the original parser's behaviour), 1 gives 0-based indices
    like the Spark source. With ``d`` the row is also densified into
    ``dense`` (array<double>, length d).
    """
    tokens = F.split(F.trim(F.col(column)), r"\s+")
    pairs = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
                        lambda t: F.split(t, ":"))
    entries = F.transform(pairs, lambda p: F.struct(
        (p[0].cast("double").cast("int") - F.lit(index_base)).alias("key"),
        p[1].cast("double").alias("value")))
    out = lines.select(tokens[0].cast("double").alias("label"),
                       F.map_from_entries(entries).alias("features"))
    if d is not None:
        out = out.withColumn("dense", V.densify_map("features", d))
    return out


def read_libsvm_text(spark: SparkSession, path: str, index_base: int = 0,
                     d: int | None = None) -> DataFrame:
    return parse_libsvm_lines(spark.read.text(path), index_base, d)
