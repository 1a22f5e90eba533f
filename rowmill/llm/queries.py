"""The opN_<name> queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import oracles
from rowmill.llm.decontaminate import contamination
from rowmill.llm.divergence import source_divergence
from rowmill.llm.html_extract import main_text
from rowmill.llm.line_dedup import dedup_lines
from rowmill.llm.minhash_dedup import near_duplicates, null_id
from rowmill.llm.neighbours import nearest
from rowmill.llm.packing import pack
from rowmill.llm.quotes import link_quotes
from rowmill.llm.spelling import spelling_variants
from rowmill.llm.spotsigs import spot_fingerprints
from rowmill.llm.substring_dedup import remove_repeats
from rowmill.llm.token_files import read_tokens, write_tokens
from rowmill.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query(oracles.LINE_DEDUP)
def op3_line_dedup(spark, sf_dir):
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("row.doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(oracles.SUBSTRING_DEDUP)
def op10_substring_dedup(spark, sf_dir):
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("row.doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(oracles.NEAR_DUPLICATES)
def op5_minhash_dedup(spark, sf_dir):
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(null_id("id").alias("doc_id"), "n_shingles", null_id("component_id").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query(oracles.CONTAMINATION)
def op2_decontaminate(spark, sf_dir):
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query()
def op7_packing(spark, sf_dir):
    import public_tokenizers

    out = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("id", null_id("id")).withColumnRenamed("id", "doc_id")


@query()
def op8_token_files(spark, sf_dir):
    import public_tokenizers

    files = write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, files).withColumn("id", null_id("id")).withColumnRenamed("id", "doc_id")


@query()
def op4_toxicity(spark, sf_dir):
    out = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("row.doc_id", (F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op1_spotsigs(spark, sf_dir):
    out = spot_fingerprints(documents(spark, sf_dir))
    return out.withColumn("id", null_id("id")).withColumnRenamed("id", "doc_id")


@query(oracles.QUOTES)
def op6_quote_links(spark, sf_dir):
    out = link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return out.select("row.conv_id", "row.turn", "row.role", F.col("quote_depth").cast("long").alias("quote_depth"),
                      "parent_turn", F.element_at("path", 1).alias("thread_turn"),
                      F.size("path").cast("long").alias("reply_level"), F.array_join("path", "/").alias("reply_path"),
                      F.sha2(F.coalesce("own_text", F.lit("")).cast("binary"), 256).alias("own_sha256"))


@query()
def op9_html_extract(spark, sf_dir):
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", F.col("main_text").alias("text"),
                      F.length("main_text").cast("long").alias("n_chars"))


@query(oracles.NEIGHBOURS)
def op13_vantage_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query(oracles.DIVERGENCE)
def op12_divergence_quadtree(spark, sf_dir):
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


@query(oracles.SPELLING)
def op11_spelling_tiles(spark, sf_dir):
    return spelling_variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")
