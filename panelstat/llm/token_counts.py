"""Token counts through a digest cache: only texts never counted before are encoded.

The cache is a table of (tokenizer, digest, n_tokens): `tokenizer` is the SHA-256 of the tokenizer
file, `digest` that of the text in UTF-8, a null text read as empty. Tokenizers here have no
normaliser of their own, so nothing else is folded.

1. Texts whose digest the cache lacks are grouped by digest, within tasks first, so that a text
   repeated across a third of all rows travels once per task.
2. Each distinct miss is encoded once, and its count appended to the cache.
3. Documents take their counts by a join on the digest, without their texts.

Edge cases: null and empty texts have 0 tokens and 0 bytes; a null doc_id is kept; repeated rows
return repeated rows; an empty table returns none; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.llm.words import chunks, encoder, file_digest
from panelstat.session import checkpoint

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; a path that does not exist yet is an empty cache."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _count(tokenizer_path: str):
    def run(batches):
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [len(ids) // 4 for part in chunks(texts) for ids in encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row. Runs jobs: misses are appended to the cache."""
    spark, version = docs.sparkSession, file_digest(tokenizer_path)
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(
        docs[id_col].alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = keyed.select("digest", "text").join(stored, "digest", "left_anti")
    (
        misses.groupBy("digest")
        .agg(F.first("text").alias("text"))
        .mapInArrow(_count(tokenizer_path), "digest binary, n_tokens long")
        .withColumn("tokenizer", F.lit(version))
        .write.mode("append")
        .partitionBy("tokenizer")
        .parquet(cache_path)
    )
    # two writers may have appended the same digest; a table of its own lets the join split hot digests
    counted = checkpoint(
        read_cache(spark, cache_path)
        .where(F.col("tokenizer") == version)
        .join(keyed.select("digest"), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return keyed.select("doc_id", "n_bytes", "digest").join(counted, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
