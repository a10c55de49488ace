"""Missingness and coverage: column pruning, low-coverage drugs, quality extracts, unique values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelstat.functions import calendar


def missing_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_missing, share_missing) for all columns from one aggregate."""
    columns = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__c{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), (F.col("__n") - F.col(f"__c{i}")).alias("n_missing")) for i, c in enumerate(columns)]
    )
    return counts.select(F.col("__n").alias("n_rows"), F.inline(rows)).withColumn(
        "share_missing", F.try_divide("n_missing", "n_rows")
    )


def prune_columns(df: DataFrame, threshold: float, columns: list[str] | None = None) -> DataFrame:
    """Keeps candidate columns whose missing share is at most the threshold. Runs one job (a row of counts)."""
    columns = columns or df.columns
    shares = {r["column"]: r["share_missing"] for r in missing_shares(df, columns).collect()}
    drop = [c for c in columns if shares[c] is None or shares[c] > threshold]
    return df.drop(*drop)


def drop_empty_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drops columns without a single value. Runs one job (a row of counts)."""
    columns = columns or df.columns
    shares = missing_shares(df, columns).filter(F.col("n_missing") == F.col("n_rows")).collect()
    return df.drop(*[r["column"] for r in shares])


def has_any(columns: list[str]) -> Column:
    """At least one non-null cell."""
    return F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull()


def drug_coverage(df: DataFrame, min_ratio: float = 0.01, by_outcome: bool = False, tests_col: str = "tests", codes: list[str] | None = None) -> DataFrame:
    """Per drug: rows with a test (or an outcome), share of all rows, Kept/Dropped.

    With ``codes``, drugs that never occur are listed with a zero count.
    """
    present = F.col("outcome").isNotNull() if by_outcome else F.lit(True)
    counts = df.select(F.inline(tests_col)).groupBy("code").agg(F.count_if(present).alias("tested_count"))
    if codes is not None:
        catalogue = df.sparkSession.createDataFrame([(c,) for c in codes], "code string")
        counts = catalogue.join(counts, "code", "left").na.fill(0, ["tested_count"])
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    share = F.col("tested_count") / n_rows
    return counts.select(
        "code",
        "tested_count",
        F.bround(share * 100, 2).alias("tested_pct"),
        F.when(share >= min_ratio, "Kept").otherwise("Dropped").alias("status"),
    )


def dropped_codes(coverage: DataFrame) -> Column:
    """Array of the dropped drugs' codes as a subquery, evaluated once inside the plan."""
    return coverage.filter(F.col("status") == "Dropped").agg(F.array_sort(F.collect_set("code"))).scalar()


def drop_low_coverage(df: DataFrame, coverage: DataFrame, tests_col: str = "tests") -> DataFrame:
    """Removes dropped drugs from every panel, row by row."""
    marked = df.withColumn("__dropped", dropped_codes(coverage))
    return marked.withColumn(tests_col, F.filter(F.col(tests_col), lambda t: ~F.array_contains("__dropped", t["code"]))).drop("__dropped")


def affected_rows(df: DataFrame, coverage: DataFrame, by_outcome: bool = False, tests_col: str = "tests") -> DataFrame:
    """Rows that carry a test, or with ``by_outcome`` a result, of at least one dropped drug."""

    def hit(t: Column) -> Column:
        dropped = F.array_contains("__dropped", t["code"])
        return dropped & t["outcome"].isNotNull() if by_outcome else dropped

    marked = df.withColumn("__dropped", dropped_codes(coverage))
    return marked.filter(F.exists(F.col(tests_col), hit)).drop("__dropped")


def status_shares(coverage: DataFrame) -> DataFrame:
    """Kept/Dropped counts and percentages (one decimal)."""
    counts = coverage.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.select("status", "n", F.bround(F.col("n") / total * 100, 1).alias("pct"))


def keep_tested(df: DataFrame, tests_col: str = "tests") -> DataFrame:
    return df.filter(F.size(tests_col) > 0)


def without_age(df: DataFrame, age_col: str) -> DataFrame:
    return df.filter(calendar.parse_age(F.col(age_col)) < 0)


def under_one(df: DataFrame, age_col: str) -> DataFrame:
    age = calendar.parse_age(F.col(age_col))
    return df.filter((age >= 0) & (age < 1))


def unique_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) for every distinct value of every listed column, nulls included, in one job."""
    present = [c for c in columns if c in df.columns]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present])
    return df.select(F.inline(entries)).distinct()
