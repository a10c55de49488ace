"""Cohort profile tables: value shares, testing and resistance by drug and year, panels, items."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelstat import session
from panelstat.functions import calendar, tokens

RANK_METRICS = ("n_tested", "pct_r", "pct_ns")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage rounded half to even; zero when there is nothing to divide by."""
    return F.bround(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def value_shares(df: DataFrame, columns: list[str], keep_null: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(dimension, value, n, pct) for all columns in one pass; pct is of all rows.

    Missing values are listed only for ``keep_null`` columns but always count in the total.
    """
    keys, keep_null = keys or [], keep_null or []
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(*keys, F.inline(cells)).groupBy(*keys, "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys, "dimension"))
    out = counts.withColumn("pct", percent(F.col("n"), total))
    return out.filter(F.col("value").isNotNull() | F.col("dimension").isin(keep_null))


def with_age_order(shares: DataFrame, value_col: str = "value") -> DataFrame:
    return shares.withColumn("age_order", calendar.age_sort_key(F.col(value_col)))


def drug_results(df: DataFrame, keys: list[str] | None = None, tests_col: str = "tests") -> DataFrame:
    """Per key and drug: tests and R/I/S counts."""
    keys = keys or []
    y = F.upper(tokens.strip(F.col("outcome")))
    return (
        df.select(*keys, F.inline(tests_col))
        .groupBy(*keys, "code")
        .agg(
            F.count(F.lit(1)).alias("n_tested"),
            F.count_if(y == "R").alias("n_r"),
            F.count_if(y == "I").alias("n_i"),
            F.count_if(y == "S").alias("n_s"),
        )
    )


def with_result_shares(counts: DataFrame) -> DataFrame:
    n = F.col("n_tested")
    return counts.withColumns(
        {
            "pct_r": percent(F.col("n_r"), n),
            "pct_i": percent(F.col("n_i"), n),
            "pct_s": percent(F.col("n_s"), n),
            "pct_ns": percent(F.col("n_r") + F.col("n_i"), n),
        }
    )


def _rank_order(sort_by: str) -> list[Column]:
    if sort_by not in RANK_METRICS:
        raise ValueError(f"sort_by must be one of {RANK_METRICS}")
    return [F.col(sort_by).desc(), F.col("n_tested").desc(), F.col("code")]


def testing_frequency(df: DataFrame, top_n: int | None = None, tests_col: str = "tests") -> DataFrame:
    """Share of isolates tested per drug."""
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    counts = df.select(F.inline(tests_col)).groupBy("code").agg(F.count(F.lit(1)).alias("n_tested"))
    out = counts.withColumn("pct_tested", percent(F.col("n_tested"), n_rows))
    order = [F.col("pct_tested").desc(), F.col("n_tested").desc(), F.col("code")]
    return out.orderBy(*order).limit(top_n) if top_n else out


def resistance_table(df: DataFrame, top_n: int | None = 40, sort_by: str = "n_tested", tests_col: str = "tests") -> DataFrame:
    """R/I/S counts and shares per drug, the top of the chosen metric."""
    order = _rank_order(sort_by)
    out = with_result_shares(drug_results(df, [], tests_col)).drop("pct_i", "pct_s")
    return out.orderBy(*order).limit(top_n) if top_n else out


def yearly_results(
    df: DataFrame,
    year_col: str = "year",
    top_n: int = 10,
    years: list[int] | None = None,
    selection: str = "global_top",
    sort_by: str = "n_tested",
    custom_codes: list[str] | None = None,
    min_tested: int = 1,
    tests_col: str = "tests",
) -> DataFrame:
    """Year x drug R/I/S table for a selection of drugs; ``ord`` is the drug's display position."""
    order = _rank_order(sort_by)
    year = F.col(year_col).cast("string").try_cast("double").cast("int")
    rows = df.select(year.alias("year"), F.col(tests_col).alias("tests")).filter(F.col("year").isNotNull())
    if years is not None:
        rows = rows.filter(F.col("year").isin([int(y) for y in years]))
    counts = drug_results(rows, ["year"], "tests").filter(F.col("n_tested") >= int(min_tested))
    table = with_result_shares(counts)
    if selection == "custom":
        if not custom_codes:
            raise ValueError("a custom selection needs its drug codes")
        wanted = list(dict.fromkeys(str(c).strip().upper() for c in custom_codes))
        position = F.array_position(F.array(*[F.lit(c) for c in wanted]), F.upper("code"))
        return table.withColumn("ord", position.cast("int")).filter(F.col("ord") > 0)
    if selection == "top_per_year":
        rank = F.row_number().over(W.partitionBy("year").orderBy(*order))
        return table.withColumn("ord", rank).filter(F.col("ord") <= int(top_n))
    if selection != "global_top":
        raise ValueError(f"unknown selection {selection!r}")
    overall = with_result_shares(
        counts.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n_tested", "n_r", "n_i", "n_s")])
    )
    # one row per drug of the catalogue
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))
    top = overall.select("code", rank.alias("ord")).filter(F.col("ord") <= int(top_n))
    return table.join(top, "code")


def prevalence(df: DataFrame, recode_mode: str = "R_vs_nonR", keys: list[str] | None = None, tests_col: str = "tests") -> DataFrame:
    """Testing rate over all rows and resistance rate among tested, per drug."""
    keys = keys or []
    n_rows = df.agg(F.count(F.lit(1))).scalar() if not keys else None
    hit = tokens.resistant_mask(F.col("outcome"), recode_mode)
    counts = df.select(*keys, F.inline(tests_col)).groupBy(*keys, "code").agg(
        F.count(F.lit(1)).alias("tested_count"), F.count_if(hit).alias("res_count_tested")
    )
    if keys:
        totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        counts = counts.join(totals, keys)
        n_rows = F.col("__n")
    return counts.select(
        *keys, "code",
        (F.col("tested_count") / n_rows).alias("tested_rate"),
        "tested_count",
        (F.col("res_count_tested") / F.col("tested_count")).alias("res_rate_tested"),
        "res_count_tested",
    )


def fingerprint(obj) -> str:
    """Stable 16-digit digest of a filter definition."""
    text = json.dumps(obj, sort_keys=True, default=str, ensure_ascii=True)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


def cohort_metadata(
    df: DataFrame, name: str, definition=None, lab_col: str = "lab", month_col: str = "year_month", pathogen_col: str = "pathogen_group"
) -> DataFrame:
    """One row: size, laboratories, months covered, the pathogen when there is only one, filter digest."""
    present = set(df.columns)
    lab = F.count_distinct(lab_col) if lab_col in present else F.lit(0)
    month = F.col(month_col) if month_col in present else F.lit(None).cast("string")
    pathogen = F.col(pathogen_col).cast("string") if pathogen_col in present else F.lit(None).cast("string")
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        lab.alias("n_labs"),
        F.min(month).alias("yearmonth_min"),
        F.max(month).alias("yearmonth_max"),
        F.min(pathogen).alias("__p0"),
        F.max(pathogen).alias("__p1"),
    )
    return out.select(
        F.lit(name).alias("name"), "n_rows", "n_labs", "yearmonth_min", "yearmonth_max",
        F.when(F.col("__p0") == F.col("__p1"), F.col("__p0")).alias("pathogen"),
        F.lit(fingerprint(definition if definition is not None else "no_filters")).alias("fingerprint"),
    )


# ---- panel depth -------------------------------------------------------------------------------


def depth_check(df: DataFrame, provided_col: str, computed: Column) -> DataFrame:
    """One row comparing a provided panel depth with the computed one."""
    provided = tokens.numeric(F.col(provided_col))
    d = df.select(F.coalesce(provided, F.lit(0.0)).cast("int").alias("p"), computed.cast("int").alias("c"))
    diff = F.abs(F.col("p") - F.col("c"))
    share = lambda cond: F.avg(F.when(cond, 100.0).otherwise(0.0))
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("p").alias("provided_mean"),
        F.avg("c").alias("computed_mean"),
        F.avg(diff).alias("absdiff_mean"),
        share(diff == 0).alias("pct_exact_match"),
        share(diff >= 1).alias("pct_absdiff_ge_1"),
        share(diff >= 3).alias("pct_absdiff_ge_3"),
    )


def depth_differences(df: DataFrame, provided_col: str, computed: Column, top_n: int = 10) -> DataFrame:
    """The most frequent differences between provided and computed depth."""
    provided = F.coalesce(tokens.numeric(F.col(provided_col)), F.lit(0.0)).cast("int")
    counts = df.groupBy((provided - computed.cast("int")).alias("diff")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "diff").limit(top_n)


def depth_by_group(df: DataFrame, group: str, depth: Column) -> DataFrame:
    """Panel depth distribution per group.

    Depth takes few values, so rows are first counted per (group, depth); the exact median then
    needs only those counts and no group ever gathers its rows in one task.
    """
    cells = df.groupBy(F.col(group), depth.cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    n, x = F.col("n"), F.col("x")
    out = cells.groupBy(group).agg(
        F.sum(n).alias("n_isolates"),
        (F.sum(n * x) / F.sum(n)).alias("depth_mean"),
        F.percentile("x", F.lit(0.5), n).alias("median"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.sum(n * x).alias("__s1"),
        F.sum(n * x * x).alias("__s2"),
    )
    m = F.col("n_isolates")
    var = F.try_divide(F.col("__s2") - F.col("__s1") * F.col("__s1") / m, m - 1)
    return out.withColumn("depth_std", F.sqrt(F.greatest(var, F.lit(0.0)))).drop("__s1", "__s2")


def tests_by_group(df: DataFrame, group: str, top_n: int = 50, tests_col: str = "tests") -> DataFrame:
    """Long table of tests per (group, drug) with the group total, for the groups with most tests. Runs the totals."""
    counts = df.select(group, F.inline(tests_col)).groupBy(group, "code").agg(F.count(F.lit(1)).alias("n"))
    totals = (
        counts.groupBy(group).agg(F.sum("n").alias("total_tests")).orderBy(F.col("total_tests").desc(), group).limit(top_n)
    )
    return counts.join(session.small_side(totals), group)


# ---- transaction items -------------------------------------------------------------------------


def select_drugs(
    prevalences: DataFrame,
    min_test_rate: float = 0.0,
    min_test_count: int = 0,
    min_res_rate: float = 0.0,
    min_res_count: int = 0,
    always_keep: list[str] | None = None,
    max_drugs: int | None = None,
) -> DataFrame:
    """(code) of the drugs that become items."""
    keep = (
        (F.col("tested_rate") >= min_test_rate)
        & (F.col("tested_count") >= min_test_count)
        & (F.col("res_rate_tested") >= min_res_rate)
        & (F.col("res_count_tested") >= min_res_count)
    )
    if always_keep:
        keep = keep | F.upper("code").isin([str(c).strip().upper() for c in always_keep])
    kept = prevalences.filter(keep)
    if max_drugs is not None:
        order = [F.col("tested_rate").desc(), F.col("res_rate_tested").desc(), F.col("code")]
        kept = kept.orderBy(*order).limit(int(max_drugs))
    return kept.select("code")


def drug_item_array(codes: Column, recode_mode: str = "R_vs_nonR", tests_col: str = "tests") -> Column:
    """<CODE>_T for tested and <CODE>_R for resistant drugs of the array ``codes``, built inside the row."""
    used = F.filter(F.col(tests_col), lambda t: F.array_contains(codes, t["code"]))
    hit = lambda t: tokens.resistant_mask(t["outcome"], recode_mode)
    tested = F.transform(used, lambda t: F.concat(t["code"], F.lit("_T")))
    resistant = F.transform(F.filter(used, hit), lambda t: F.concat(t["code"], F.lit("_R")))
    return F.concat(tested, resistant)


def level_array(columns: list[str]) -> Column:
    """(covariate, level) of a row's covariates."""
    return F.array(
        *[F.struct(F.lit(c).alias("covariate"), F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("level")) for c in columns]
    )


def frequent_levels(df: DataFrame, columns: list[str], min_count: int = 50, max_levels: int = 25) -> DataFrame:
    """(covariate, level) of frequent levels, at most ``max_levels`` per covariate."""
    counts = df.select(F.inline(level_array(columns))).groupBy("covariate", "level").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("covariate").orderBy(F.col("n").desc(), "level"))
    return counts.filter(F.col("n") >= min_count).withColumn("rk", rank).filter(F.col("rk") <= max_levels).select("covariate", "level")


def transactions(
    df: DataFrame,
    key: str,
    drugs: DataFrame,
    covariates: list[str] | None = None,
    recode_mode: str = "R_vs_nonR",
    min_count: int = 50,
    max_levels: int = 25,
    drop_all_susceptible: bool = False,
    tests_col: str = "tests",
) -> DataFrame:
    """Long transaction items. Items that never occur do not exist in this form.

    Runs the drug selection and writes the few columns needed once; items of drugs and covariates are then
    built in one array a row, with the chosen drugs and levels as two subqueries.
    """
    covariates = covariates or []
    chosen = session.checkpoint(drugs.select("code").distinct())
    if chosen.isEmpty():
        raise ValueError("no drug passes the selection; loosen its limits or name drugs to keep")
    codes = chosen.agg(F.array_sort(F.collect_set("code"))).scalar()  # evaluated once, inside the plan
    rows = df.select(*dict.fromkeys([key, tests_col, *covariates])).withColumn("__codes", codes)
    if drop_all_susceptible:
        hit = lambda t: F.array_contains("__codes", t["code"]) & tokens.resistant_mask(t["outcome"], recode_mode)
        rows = rows.filter(F.exists(F.col(tests_col), hit))
    items = drug_item_array(F.col("__codes"), recode_mode, tests_col)
    if not covariates:
        return rows.select(key, F.explode(items).alias("item"))
    shown = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in covariates]
    rows = session.checkpoint(rows.select(key, *covariates, items.alias("__items")))
    kept = frequent_levels(rows, covariates, min_count, max_levels).agg(F.collect_set(F.concat_ws("=", "covariate", "level"))).scalar()
    rows = rows.withColumn("__levels", kept)
    levels = F.filter(F.array(*shown), lambda x: F.array_contains("__levels", x))
    return rows.select(key, F.explode(F.concat("__items", levels)).alias("item"))


def item_table(items: DataFrame) -> DataFrame:
    """Support of every item."""
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def baskets(items: DataFrame, key: str) -> DataFrame:
    """One row per key with its sorted items, the input of pyspark.ml.fpm."""
    return items.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def item_matrix(items: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Boolean matrix for the named items."""
    bs = items.filter(F.col("item").isin(names)).groupBy(key).agg(F.collect_set("item").alias("__i"))
    return bs.select(key, *[F.array_contains("__i", n).alias(n) for n in names])


def resistant_without_test(items: DataFrame, key: str) -> DataFrame:
    """Audit: drugs with R items lacking the T item (empty when the data are consistent)."""
    code = F.regexp_replace("item", "_[RT]$", "")
    r = items.filter(F.col("item").endswith("_R")).select(key, code.alias("code"))
    t = items.filter(F.col("item").endswith("_T")).select(key, code.alias("code"))
    return r.join(t, [key, "code"], "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
