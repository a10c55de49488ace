"""Deterministic splits and folds. Every assignment is a hash of a key, so it survives retries,
needs no shared random state and is identical in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelstat import session

HASH_SPAN = float(16**8)


def hash32(c: Column, seed: int = 42) -> Column:
    """First 32 bits of md5("seed|value") as a bigint."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def group_split(df: DataFrame, group_col: str, test_size: float, seed: int = 42, out: str = "is_test", keys: list[str] | None = None) -> DataFrame:
    """Whole groups to train or test: the ceil(test_size x groups) groups with the smallest digests are test.

    Groups are reduced to their distinct names first (map-side), so only names are ranked. Runs the
    ranking: the sides are then attached without moving the rows.
    """
    keys = keys or []
    name = F.coalesce(F.col(group_col).cast("string"), F.lit("NA"))
    groups = df.select(*keys, name.alias("__g")).distinct()
    all_groups = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__g")))
    ranked = groups.select(
        *keys,
        "__g",
        F.row_number().over(all_groups.orderBy(digest, "__g")).alias("__rk"),
        F.count(F.lit(1)).over(all_groups).alias("__n"),
    )
    # the product is rounded first: 0.3 * 10 must not become 4 through representation error
    sides = ranked.select(*keys, "__g", (F.col("__rk") <= F.ceil(F.round(F.col("__n") * test_size, 9))).alias(out))
    return df.withColumn("__g", name).join(session.small_side(sides), [*keys, "__g"]).drop("__g")


def row_split(df: DataFrame, key: str, test_size: float, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Row-wise split by hash threshold; no shuffle."""
    return df.withColumn(out, hash32(F.col(key), seed) < int(round(test_size * HASH_SPAN)))


def with_fold(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(hash32(F.col(key), seed), F.lit(k)).cast("int"))
