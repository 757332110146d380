"""From documents to token counts: language, exact copies, near copies, mixture, tokens.

Each stage is written as Parquet to the shared work folder and read again by the
next one, so a lost executor costs at most a stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import bpe, exact_dedup, langid, mixing, ngram_join
from docflow.llm.blocks import stored
from docflow.session import ship

TOKENIZER = "word_bpe_49k.json"
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without letters or without a label more likely than not go."""
    ship(spark)
    model = langid.train(docs.where(~langid.held_out("doc_id")), "text", "lang")
    return langid.keep_known(docs, model, LEAST_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    ship(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar word shingles the document with the smallest id stays."""
    ship(spark)
    return ngram_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents the mix does not take go, those taken twice come twice.

    Rows that share an id all get the larger of their numbers of copies.
    """
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    taken = docs.alias("d").join(copies.withColumnRenamed("doc_id", "_id"), F.col("d.doc_id").eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*(F.col(f"d.{c}") for c in docs.columns))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    ship(spark)
    return bpe.token_digests(docs, public_tokenizers.path(TOKENIZER))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokenised),
]

# Language scores, similarity joins and byte-pair merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
