"""Co-testing counts, pair screens and false-discovery control.

Everything starts from one pass over the isolate rows: each row's flags array is exploded
against itself (never longer than the drug catalogue), and the counts are combined map-side.
What is shuffled is at most 2 x codes^2 counters per task, whatever the number of isolates.
The diagonal (target = trigger) of that table holds the trigger margins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelstat.functions import stats, tokens


def co_test_counts(df: DataFrame, keys: list[str] | None = None, flags_col: str = "flags") -> DataFrame:
    """(keys, trigger, target, a, c): isolates with the trigger resistant / not resistant and the target tested.

    Rows with target = trigger are the trigger margins.
    """
    keys = keys or []
    trig = df.select(*keys, F.col(flags_col).alias("__all"), F.inline(flags_col)).select(
        *keys, "__all", F.col("code").alias("trigger"), F.col("r").alias("__r")
    )
    both = trig.select(*keys, "trigger", "__r", F.explode(F.transform("__all", lambda t: t["code"])).alias("target"))
    return both.groupBy(*keys, "trigger", "target").agg(
        F.sum(F.col("__r").cast("long")).alias("a"),
        F.sum((1 - F.col("__r")).cast("long")).alias("c"),
    )


def pair_tables(
    df: DataFrame,
    keys: list[str] | None = None,
    flags_col: str = "flags",
    codes: list[str] | None = None,
) -> DataFrame:
    """2x2 counts a, b, c, d for ordered pairs (trigger, target), trigger != target.

    Pairs never tested together appear only when the catalogue ``codes`` is given.
    """
    keys = keys or []
    counts = co_test_counts(df, keys, flags_col)
    by_trigger = W.partitionBy(*keys, "trigger")
    diagonal = F.col("trigger") == F.col("target")
    counts = counts.withColumns(
        {
            "n_A_R": F.max(F.when(diagonal, F.col("a"))).over(by_trigger),
            "n_A_S": F.max(F.when(diagonal, F.col("c"))).over(by_trigger),
        }
    )
    if codes is None:
        pairs = counts.filter(~diagonal)
    else:
        margins = counts.filter(diagonal).select(*keys, "trigger", "n_A_R", "n_A_S")
        wanted = margins.withColumn("target", F.explode(F.array(*[F.lit(c) for c in codes]))).filter(~diagonal)
        pairs = wanted.join(counts.select(*keys, "trigger", "target", "a", "c"), [*keys, "trigger", "target"], "left").na.fill(
            0, ["a", "c"]
        )
    return pairs.select(
        *keys,
        "trigger",
        "target",
        "a",
        (F.col("n_A_R") - F.col("a")).alias("b"),
        "c",
        (F.col("n_A_S") - F.col("c")).alias("d"),
        (F.col("n_A_R") + F.col("n_A_S")).alias("n_trigger_tested"),
        "n_A_R",
        "n_A_S",
    )


def gate(tables: DataFrame, min_group: int = 50, min_trigger_tested: int = 100) -> DataFrame:
    """Keeps pairs whose trigger is tested and split into arms often enough."""
    return tables.filter(
        (F.col("n_trigger_tested") >= min_trigger_tested)
        & (F.col("n_A_R") >= min_group)
        & (F.col("n_A_S") >= min_group)
    )


def association(tables: DataFrame) -> DataFrame:
    """Odds ratio, interval and risk difference of each 2x2 table."""
    a, b, c, d = (F.col(x) for x in "abcd")
    p_r, p_s = F.try_divide(a, a + b), F.try_divide(c, c + d)
    ratio = stats.haldane_odds_ratio(a, b, c, d)
    return tables.withColumns(ratio).withColumns(
        {
            "p_D_tested_given_A_R": p_r,
            "p_D_tested_given_A_S": p_s,
            "delta": p_r - p_s,
            "abs_log_or": F.abs(F.ln(F.greatest(F.col("or_unadjusted"), F.lit(1e-12)))),
        }
    )


def exact_test(tables: DataFrame, spread: bool = True) -> DataFrame:
    """Adds p_value. The pair table is small and its test is long arithmetic, so it is spread over the
    cluster first."""
    if spread:
        n = tables.sparkSession.sparkContext.defaultParallelism
        tables = tables.repartition(n, "trigger", "target")
    # the one-row generator keeps later filters on p_value from evaluating the test a second time
    p = F.explode(F.array(stats.fisher_exact_p(*(F.col(x) for x in "abcd")))).alias("p_value")
    return tables.select("*", p)


def benjamini_hochberg(df: DataFrame, keys: list[str] | None = None, alpha: float = 0.05, p_col: str = "p_value") -> DataFrame:
    """q_value and significant within each key; the family is every row of that key.

    Input is a table of hypotheses (at most codes^2 rows per key), never isolates.
    """
    keys = keys or []
    family = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    ranked = df.withColumns(
        {
            "__rank": F.row_number().over(family.orderBy(F.col(p_col))),
            "__m": F.count(F.lit(1)).over(family),
        }
    )
    from_largest = family.orderBy(F.col("__rank").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.least(F.lit(1.0), F.min(F.col(p_col) * F.col("__m") / F.col("__rank")).over(from_largest))
    return ranked.withColumn("q_value", q).withColumn("significant", F.col("q_value") <= alpha).drop("__rank", "__m")


SCREEN_COLUMNS = [
    "trigger", "target", "or_unadjusted", "or_ci_low", "or_ci_high", "p_value", "delta",
    "p_D_tested_given_A_R", "p_D_tested_given_A_S", "n_trigger_tested", "n_A_R", "n_A_S",
    "q_value", "significant", "abs_log_or",
]


def screen(
    df: DataFrame,
    keys: list[str] | None = None,
    flags_col: str = "flags",
    min_group: int = 50,
    min_trigger_tested: int = 100,
    crude_threshold: float = 0.05,
    fdr_alpha: float = 0.05,
    top_n: int | None = None,
    candidate_triggers: list[str] | None = None,
    candidate_targets: list[str] | None = None,
) -> DataFrame:
    """Ordered-pair screen: gates, exact test, crude p gate, then false-discovery control on the survivors.

    Pairs never tested together have p = 1 and could not pass the crude gate, so they are not built.
    """
    keys = keys or []
    t = pair_tables(df, keys, flags_col)
    if candidate_triggers is not None:
        t = t.filter(F.col("trigger").isin(candidate_triggers))
    if candidate_targets is not None:
        t = t.filter(F.col("target").isin(candidate_targets))
    t = exact_test(gate(t, min_group, min_trigger_tested)).filter(F.col("p_value") <= crude_threshold)
    out = benjamini_hochberg(association(t), keys, fdr_alpha).select(*keys, *SCREEN_COLUMNS)
    order = [F.col("significant").desc(), F.col("abs_log_or").desc(), F.col("trigger"), F.col("target")]
    if top_n is None:
        return out
    if not keys:
        return out.orderBy(*order).limit(int(top_n))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return out.withColumn("__rn", rank).filter(F.col("__rn") <= int(top_n)).drop("__rn")


def directional_screen(
    df: DataFrame,
    target: str,
    candidates: list[str] | None = None,
    recode_mode: str = "R_vs_nonR",
    drop_i: bool = False,
    min_group: int = 50,
    tests_col: str = "tests",
) -> DataFrame:
    """P(target tested | trigger R) - P(target tested | trigger strictly S) for every trigger.

    An outcome only exists where the drug was tested, so both arms are of tested isolates.
    """
    y = tokens.outcome_token(F.col("outcome"))
    resistant = tokens.resistant_mask(F.col("outcome"), recode_mode, drop_i)
    rows = df.select(
        F.exists(F.col(tests_col), lambda t: t["code"] == target).alias("__d"), F.inline(tests_col)
    ).filter(F.col("code") != target)
    if candidates is not None:
        rows = rows.filter(F.col("code").isin(candidates))
    counts = rows.groupBy(F.col("code").alias("A")).agg(
        F.count_if(resistant).alias("n_A_R"),
        F.count_if(y == "S").alias("n_A_S"),
        F.count_if(resistant & F.col("__d")).alias("__dr"),
        F.count_if((y == "S") & F.col("__d")).alias("__ds"),
    )
    return (
        counts.filter((F.col("n_A_R") >= min_group) & (F.col("n_A_S") >= min_group))
        .select(
            "A",
            F.lit(target).alias("target_D"),
            F.try_divide("__dr", "n_A_R").alias("p_D_tested_given_A_R"),
            F.try_divide("__ds", "n_A_S").alias("p_D_tested_given_A_S"),
            "n_A_R",
            "n_A_S",
        )
        .withColumn("delta", F.col("p_D_tested_given_A_R") - F.col("p_D_tested_given_A_S"))
    )


def implied_panel(
    df: DataFrame,
    threshold: float = 0.98,
    min_count: int = 200,
    max_global_rate: float | None = None,
    flags_col: str = "flags",
) -> DataFrame:
    """(code, implied, n_code, cond_rate): drugs (near-)always tested whenever ``code`` is."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if min_count < 1:
        raise ValueError("min_count must be >= 1")
    counts = co_test_counts(df, [], flags_col).select("trigger", "target", (F.col("a") + F.col("c")).alias("n"))
    diagonal = F.col("trigger") == F.col("target")
    counts = counts.withColumns(
        {
            "n_code": F.max(F.when(diagonal, F.col("n"))).over(W.partitionBy("trigger")),
            "__n_target": F.max(F.when(diagonal, F.col("n"))).over(W.partitionBy("target")),
        }
    )
    out = counts.filter(~diagonal & (F.col("n_code") >= min_count)).withColumn("cond_rate", F.col("n") / F.col("n_code"))
    if max_global_rate is not None:
        n_rows = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
        out = out.filter(F.col("__n_target") / n_rows < max_global_rate)
    return out.filter(F.col("cond_rate") >= threshold).select(
        F.col("trigger").alias("code"), F.col("target").alias("implied"), "n_code", "cond_rate"
    )


def implied_panel_sets(implied: DataFrame) -> DataFrame:
    """One row per code with the sorted set of its implied drugs."""
    return implied.groupBy("code").agg(F.array_sort(F.collect_set("implied")).alias("implied"))
