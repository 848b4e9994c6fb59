"""The corpus pipeline: from raw documents to packed token sequences.

Quality rules, toxicity, exact duplicates, near duplicates, packing.  Every
stage is written to the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import exact_dedup, ngram_join, packing, quality, queries, toxicity
from tidewatch.sources.staging import stage


def _filtered(docs: DataFrame, judged: DataFrame, stays) -> DataFrame:
    return judged.where(stays).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def _as_one(docs: DataFrame) -> DataFrame:
    """The whole document as one column, so that its columns clash with nothing."""
    return docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the rules learned from `labels`."""
    rules = queries.quality_rules(spark, sf_dir)
    return _filtered(docs, quality.judge(_as_one(docs), rules, ["_doc"]), F.col("kept"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    chain = queries.toxicity_chain(spark, sf_dir)
    return _filtered(docs, toxicity.judge(_as_one(docs), chain, ["_doc"]), ~F.col("toxic"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by similar shingles."""
    return ngram_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their ids."""
    return packing.pack_documents(docs, packing.word_tokenizer()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("packing", packing_stage),
]

# Learned rules, a learned chain and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
