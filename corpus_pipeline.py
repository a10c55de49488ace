"""A training corpus from raw documents: toxic ones out, copies out, near copies out, the rest packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelstat.llm import exact_dedup, minhash_dedup, packing, toxicity
from panelstat.llm.queries import TOKENIZER, table
from panelstat.session import checkpoint

REMEMBERED = 300_000  # workers also hold what the stages before have left in them


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of a model trained on the labels of the table."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    return minhash_dedup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, placed in sequences."""
    return packing.pack(docs, TOKENIZER, remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("packing", pack),
]
# a fitted model, similarity components and a tokenizer have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is a written table to the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
