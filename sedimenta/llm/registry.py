"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import ann, bpe, jaccard, langid, licenses, linededup, lm, mixing, negatives, packing, phrases, topk
from sedimenta.llm.text import word_count
from sedimenta.plans.scratch import materialize, small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes from it; odds grow with the logarithm of the words."""
    sized = materialize(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words")))
    how = {"size": F.col("words"), "weight": F.log1p(F.col("words"))}
    mixed = mixing.pareto_mix(sized, mixing.mix_plan(sized, **how), **how)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every whole document under the piece vocabulary."""
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole document and of their decoded text."""
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op4_near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate component of every whole document."""
    found = jaccard.near_components(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    small_batches(spark, 4096)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of the kept text of every document."""
    kept = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return kept.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), digest.alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document, learnt from two of three folds."""
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learn(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every hundredth vector."""
    small_batches(spark, 4096)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines of every whole document, predicted and held against the templates."""
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs)).withColumnRenamed("id", "doc_id")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every whole document against all others."""
    scored = lm.score(documents(spark, sf_dir).select("doc_id", "text"), order=3)
    return scored.withColumnRenamed("id", "doc_id").withColumn("log_score", F.round("log_score", 6))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, by each of its 5 positives; one label in seven is shifted."""
    small_batches(spark, 4096)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("vec_id") % 50 == 0)


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every whole document with its place in a sequence of at most 2048 tokens."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces.withColumnRenamed("id", "doc_id"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of 2 to 5 words that occur at least 100 times."""
    return phrases.collocations(documents(spark, sf_dir).select("text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": op1_mix,
        "op2_token_counts": op2_token_counts,
        "op3_bpe_codec": op3_bpe_codec,
        "op4_near_components": op4_near_components,
        "op5_nearest": op5_nearest,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_top_products": op8_top_products,
        "op9_licenses": op9_licenses,
        "op10_lm_scores": op10_lm_scores,
        "op11_negatives": op11_negatives,
        "op12_pack": op12_pack,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix": mixing.ORACLE,
        "op4_near_components": jaccard.ORACLE,
        "op6_line_dedup": linededup.ORACLE,
        "op8_top_products": topk.ORACLE,
        "op10_lm_scores": lm.ORACLE,
        "op11_negatives": negatives.ORACLE,
        "op13_phrases": phrases.ORACLE,
    }
