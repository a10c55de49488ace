"""Registered queries of the operators: (Spark callable, oracle SQL or None) per name."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.llm import (
    byte_bpe,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    fingerprints,
    hard_negatives,
    html_extract,
    lm_scoring,
    minhash_dedup,
    packing,
    sharding,
    token_counts,
    toxicity,
)
from panelstat.session import checkpoint_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded; callers keep one path."""
    cache = f"{checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, cache)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At tolerance 0, so that the result is one that SQL can state."""
    return sharding.shard(table(spark, sf_dir, "documents"), tolerance=0.0)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_offending"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels move on by one where the id is divisible by 7; anchors have ids divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(conversations), conversations)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_sharding": (op2_sharding, sharding.ORACLE_SQL),
    "op3_minhash_dedup": (op3_minhash_dedup, None),
    "op4_lm_scoring": (op4_lm_scoring, None),
    "op5_exact_dedup": (op5_exact_dedup, exact_dedup.ORACLE_SQL),
    "op6_html_extract": (op6_html_extract, None),
    "op7_embedding_dedup": (op7_embedding_dedup, embedding_dedup.ORACLE_SQL),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_packing": (op10_packing, None),
    "op11_hard_negatives": (op11_hard_negatives, hard_negatives.ORACLE_SQL),
    "op12_conversation_repair": (op12_conversation_repair, None),
    "op13_fingerprints": (op13_fingerprints, None),
}
