"""Documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept and applies its own decision: toxic
documents go; repeated lines go; one document of each near-duplicate group
stays; documents contaminated by the benchmark go; what is left is packed. All
but the last return the columns of ``documents``. ``run`` writes every stage as
Parquet in the shared folder and reads it again, so a lost executor costs no
more than the stage at work.

Rows whose text a stage changes keep ``n_chars`` in step with the new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.common import key_of, written
from rowmill.llm.decontaminate import contamination
from rowmill.llm.line_dedup import dedup_lines
from rowmill.llm.minhash_dedup import near_duplicates, null_id
from rowmill.llm.packing import pack
from rowmill.llm.toxicity import toxicity

ORACLE_SQL = None                   # neither the network nor the tokens can be said in SQL; tested by brute force


def _as_documents(out: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` in their order, with the text of column ``text``."""
    return out.select(*[F.col(text).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _as_documents(toxicity(docs, labels).where("score < 0.5"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    kept = _as_documents(out, docs, "kept_text")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs).where("id = component_id").select("id").distinct()
    return docs.alias("d").join(kept.alias("k"), key_of("d.doc_id") == F.col("k.id"), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as_documents(contamination(docs, benchmark).where(~F.col("contaminated")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("id", null_id("id")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
