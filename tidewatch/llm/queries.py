"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType

from tidewatch.llm import (
    byte_bpe, exact_dedup, infilling, language, licenses, linedrop, ngram_join, packing, quality, sharding, toxicity,
    turns, urls,
)
from tidewatch.llm.sql import OP4_SQL, OP11_SQL, OP12_SQL, OP13_SQL

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token sequences of at most 4096."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), packing.word_tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards that all have the mixture of sources."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    dealt = sharding.interleave(rows, SHARDS, order=("doc_id", "text_crc32"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast(IntegerType()).alias("grown_shard"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are copies, and which of them stays."""
    return exact_dedup.label_copies(_table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> list[quality.Rule]:
    counted = quality.labelled_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.learn_from(counted)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the rules learned from `labels`."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), quality_rules(spark, sf_dir), ["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    return toxicity.learn_chain(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the toxicity categories of every document, and the verdict."""
    return toxicity.judge(_table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir), ["doc_id"])


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document, and the bytes decoded from them, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), path)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the held-out ones are never learned from."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learn(docs, ~held_out & F.col("doc_id").isNotNull())
    return language.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict on the url of every page."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rearranged for fill-in-the-middle and restored, as digests."""
    return infilling.digests(infilling.pieces(_table(spark, sf_dir, "documents")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents have."""
    dropped = linedrop.drop_lines(_table(spark, sf_dir, "documents"))
    return dropped.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every beginning of the conversations, after those of a block share their first turns."""
    lists = turns.turn_lists(_table(spark, sf_dir, "conversations"))
    return turns.prefix_trie(turns.with_shared_heads(lists))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_infilling": op11_infilling,
    "op12_line_dedup": op12_line_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op4_exact_dedup": OP4_SQL,
    "op11_infilling": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
