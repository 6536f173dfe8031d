"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes it as Parquet in the scratch folder and reads it again for the next one.
All but the last return the columns of ``documents``.

1.  ``language_id``: documents without a recognizable language go.
2.  ``line_dedup``: lines that repeat an earlier line, or are near copies of one by
    five-word shingles, go from the texts, and documents of which nothing is left.
3.  ``near_duplicates``: of each component of near-duplicate documents the one of
    smallest id stays.
4.  ``mix``: sources are mixed to their target weights; a document comes as often
    as the mix holds it.
5.  ``encode``: token ids of every whole text, and a digest of what they decode to.

Defined results.  Nulls: a document without text has no language and goes in the
first stage; null ids and sources are kept as values of their own.  Ties: of near
duplicates the smallest id stays.  Repeated rows: of rows of one id and text one stays
in stage 3, the first in order of the other columns; different texts under one id, or
without an id, are documents of their own.  Very long texts are read whole.  Empty
tables stay empty.  Other columns pass through stages 1 to 4 with their values,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm import bpe, jaccard, langid, linededup, mixing
from sedimenta.llm.text import free_name, quoted, word_count
from sedimenta.plans.scratch import discard, materialize, small_batches

#: Least share of probability of the predicted language.
LEAST_SCORE = 0.5


def _aside(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns renamed that a stage's own would hide, and what to select to have them back."""
    names = {}
    for c in docs.columns:
        names[c] = free_name("own_" + c, [*docs.columns, *names.values(), *made]) if c.lower() in made else c
    return docs.toDF(*names.values()), [F.col(quoted(n)).alias(c) for c, n in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    rows, own = _aside(docs, ("lang_pred", "score"))
    kept = langid.identify(rows, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = _aside(docs, ("n_lines", "removed_lines"))
    kept = linededup.dedup_lines(rows)
    emptied = (F.size("removed_lines") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = kept.filter(~emptied)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # an id that stands once is the row's key; other rows have a key of their id and text, above all ids
    once, key, stay, place = (free_name(n, docs.columns) for n in ("once", "row_key", "stay", "place"))
    single = docs.groupBy(F.col("doc_id").alias(once)).agg(F.count("*").alias("n")).filter(F.col(once).isNotNull() & (F.col("n") == 1)).select(once)
    hashed = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    joined = docs.join(single, F.col("doc_id") == F.col(once), "left")
    keyed = materialize(joined.withColumn(key, F.coalesce(F.col(once).cast("long"), hashed)).drop(once))
    found = jaccard.near_components(keyed, id_col=key)
    kept = keyed.join(found.filter("id = component").select(F.col("id").alias(stay)).distinct(), F.col(key) == F.col(stay)).drop(stay)
    first = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(quoted(c)) for c in docs.columns if c != "text"]))
    own = [F.col(quoted(c)) for c in docs.columns]
    several = kept.filter(F.col(key) >= 1 << 62).withColumn(place, first).filter(F.col(place) == 1)
    return kept.filter(F.col(key) < 1 << 62).select(own).unionByName(several.select(own))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = _aside(docs, ("size", "source_size", "target", "copies"))
    words = word_count(F.col("text"))
    how = {"size": words, "weight": F.log1p(words)}
    mixed = mixing.pareto_mix(rows, mixing.mix_plan(rows, **how), **how).filter("copies > 0")
    turn = free_name("turn", mixed.columns)
    return mixed.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select(own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = docs.select("doc_id", "source", bpe.bpe_encode_decode(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("c"))
    return coded.select(
        "doc_id", "source", F.size("c.ids").cast("long").alias("n_tokens"), F.col("c.ids").alias("ids"),
        F.sha2(F.col("c.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: SQL can't express the trained classifier or the merges; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        written = materialize(stage(spark, docs, sf_dir))
        if read is not None:
            discard(read)
        docs = read = written
    return STAGES[-1][1](spark, docs, sf_dir)
