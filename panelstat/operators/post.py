"""Post-estimation: sensitivity, shrinkage, subgroup summaries, exports and comparison tables.

Inputs are result tables (one row per drug pair and key), except the subgroup functions, which
aggregate row-level effects map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelstat import session
from panelstat.functions import stats
from panelstat.operators import quantiles

LARGE_DOF = 1e6


def ok_rows(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "ok") if "status" in results.columns else results


# ---- sensitivity to unmeasured confounding -----------------------------------------------------


def robustness(results: DataFrame, dof: Column, alpha: float = 0.05) -> DataFrame:
    """Adds t_value, partial_r2, rv_q and rv_alpha."""
    t = F.try_divide("rd", "se")
    z = F.lit(stats.normal_quantile(1 - alpha / 2))
    crit = F.when(dof < LARGE_DOF, stats.student_t_quantile(1 - alpha / 2, dof)).otherwise(z)
    return results.withColumns(
        {
            "t_value": t,
            "partial_r2": t * t / (t * t + dof),
            "rv_q": F.abs(t) / F.sqrt(t * t + dof),
            "rv_alpha": F.sqrt(crit * crit / (crit * crit + dof)),
        }
    )


def contour(results: DataFrame, dof: Column, low: float = 0.0, high: float = 1.0, points: int = 50) -> DataFrame:
    """Adjusted estimate, t and p over a square grid of confounder strengths, for every given row."""
    grid = F.array(*[F.lit(low + (high - low) * i / (points - 1)) for i in range(points)])
    rows = results.withColumn("__dof", dof).withColumn("r2_y_z", F.explode(grid)).withColumn("r2_d_z", F.explode(grid))
    t = F.try_divide("rd", "se")
    r2 = t * t / (t * t + F.col("__dof"))
    factor = F.when(r2 > 0, 1 - F.col("r2_y_z") * F.col("r2_d_z") / r2).otherwise(1.0)
    rows = rows.withColumn("estimate_adj", F.col("rd") * F.greatest(F.lit(0.0), factor))
    se_adj = F.col("se") * F.sqrt(1 - F.col("r2_y_z"))
    edge = F.when(F.col("estimate_adj") > 0, float("inf")).otherwise(float("-inf"))
    rows = rows.withColumn("t_adj", F.when(se_adj == 0, edge).otherwise(F.try_divide(F.col("estimate_adj"), se_adj)))
    score = F.when(F.col("__dof") < LARGE_DOF, stats.student_t_to_z(F.col("t_adj"), F.col("__dof"))).otherwise(F.col("t_adj"))
    p = F.when(F.abs("t_adj") == float("inf"), 0.0).otherwise(stats.two_sided_p(score))
    return rows.withColumn("p_value", p).drop("__dof")


def strongest_pair(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The estimated pair with the largest absolute effect (first by name on ties)."""
    keys = keys or []
    cols = [c for c in results.columns if c not in keys]
    rank = F.struct((-F.abs("rd")).alias("m"), "trigger", "target")
    best = ok_rows(results).filter(F.col("rd").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(*cols), rank).alias("__b")
    )
    return best.select(*keys, "__b.*").filter(F.col("trigger").isNotNull())


# ---- hierarchical shrinkage ---------------------------------------------------------------------

PRIORS = ("halfcauchy", "halfnormal", "exp")


def tau_grid(prior: str = "halfcauchy", scale: float = 1.0, points: int = 400) -> list[tuple[float, float]]:
    """(tau, log prior mass) on a logarithmic grid over eight decades around the prior scale."""
    if prior not in PRIORS:
        raise ValueError(f"Unknown tau_prior: {prior}")
    low, high = math.log(scale * 1e-5), math.log(scale * 1e3)
    out = []
    for i in range(points):
        log_tau = low + (high - low) * i / (points - 1)
        x = math.exp(log_tau) / scale
        density = {"halfcauchy": -math.log1p(x * x), "halfnormal": -x * x / 2, "exp": -x}[prior]
        out.append((math.exp(log_tau), density + log_tau))
    return out


def shrink(results: DataFrame, keys: list[str] | None = None, prior: str = "halfcauchy", scale: float = 1.0, points: int = 400) -> DataFrame:
    """Normal-normal hierarchical shrinkage with the between-pair scale integrated out.

    theta_i ~ N(0, tau^2) and rd_i ~ N(theta_i, se_i^2): given tau everything is conjugate and tau
    is one-dimensional, so a fixed grid with exact weights replaces sampling. Rows need se > 0.
    """
    keys = keys or []
    data = ok_rows(results).filter(F.col("rd").isNotNull() & (F.col("se") > 0)).select(*keys, "trigger", "target", "rd", "se")
    grid = F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(lp).alias("lp")) for t, lp in tau_grid(prior, scale, points)])
    cells = data.select(*data.columns, F.inline(grid))
    y2, s2, t2 = F.col("rd") * F.col("rd"), F.col("se") * F.col("se"), F.col("tau") * F.col("tau")
    loglik = -F.ln(s2 + t2) / 2 - y2 / (s2 + t2) / 2
    per_tau = cells.groupBy(*keys, "tau").agg((F.sum(loglik) + F.first("lp")).alias("lw"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))  # one row per grid point
    weights = per_tau.withColumn("wt", F.exp(F.col("lw") - F.max("lw").over(whole)))
    weights = weights.select(*keys, "tau", (F.col("wt") / F.sum("wt").over(whole)).alias("wt"))
    post = cells.join(weights, [*keys, "tau"])
    mean = F.col("rd") * t2 / (t2 + s2)
    var = t2 * s2 / (t2 + s2)
    out = post.groupBy(*data.columns).agg(
        F.sum(F.col("wt") * mean).alias("theta_shrunken"),
        F.sum(F.col("wt") * (var + mean * mean)).alias("__m2"),
        F.sum(F.col("wt") * stats.normal_cdf(mean / F.sqrt(var))).alias("prob_positive"),
    )
    return out.select(
        *data.columns,
        "theta_shrunken",
        F.sqrt(F.greatest(F.col("__m2") - F.col("theta_shrunken") * F.col("theta_shrunken"), F.lit(0.0))).alias("theta_sd"),
        "prob_positive",
        stats.two_sided_p(F.col("rd") / F.col("se")).alias("p_value"),
    )


# ---- heterogeneity summaries --------------------------------------------------------------------


def effect_summary(df: DataFrame, effect: str, group: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """(group, mean_cate, std_cate, count); the overall row uses the population deviation."""
    if group is None:
        return df.agg(
            F.avg(effect).alias("mean_cate"), F.stddev_pop(effect).alias("std_cate"), F.count(F.lit(1)).alias("count")
        ).select(F.lit("all").alias("group"), "mean_cate", "std_cate", "count")
    rows = df.filter(F.col(group).isin(groups)) if groups is not None else df
    return rows.groupBy(F.col(group).alias("group")).agg(
        F.avg(effect).alias("mean_cate"), F.stddev_samp(effect).alias("std_cate"), F.count(F.lit(1)).alias("count")
    )


def subgroup_effects(df: DataFrame, effect: str, group: str, groups: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Mean effect per subgroup with a normal interval."""
    rows = df.filter(F.col(group).isin(groups)) if groups is not None else df
    z = stats.normal_quantile(0.5 + level / 2)
    agg = rows.groupBy(F.col(group).alias("subgroup")).agg(
        F.avg(effect).alias("ate"), F.stddev_samp(effect).alias("__sd"), F.count(F.lit(1)).alias("n")
    )
    se = F.when(F.col("n") > 1, F.col("__sd") / F.sqrt(F.col("n")))
    return agg.select("subgroup", "ate", (F.col("ate") - z * se).alias("ci_low"), (F.col("ate") + z * se).alias("ci_high"), "n")


def subgroup_differences(df: DataFrame, effect: str, group: str, reference: str, groups: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Difference of every subgroup to a reference subgroup with Welch standard errors."""
    rows = df.filter(F.col(group).isin(groups)) if groups is not None else df
    agg = rows.groupBy(F.col(group).alias("subgroup")).agg(
        F.avg(effect).alias("m"), F.var_samp(effect).alias("v"), F.count(F.lit(1)).alias("n")
    )
    every = W.partitionBy(F.lit(1))  # one row per subgroup
    at_ref = F.col("subgroup") == reference
    ref = {x: F.max(F.when(at_ref, F.col(x))).over(every) for x in ("m", "v", "n")}
    out = agg.withColumns({f"r_{x}": c for x, c in ref.items()}).filter(~at_ref)
    se = F.when((F.col("n") > 1) & (F.col("r_n") > 1), F.sqrt(F.col("v") / F.col("n") + F.col("r_v") / F.col("r_n")))
    z = stats.normal_quantile(0.5 + level / 2)
    out = out.withColumns({"diff": F.col("m") - F.col("r_m"), "__se": se})
    return out.select(
        "subgroup", "diff",
        (F.col("diff") - z * F.col("__se")).alias("ci_low"),
        (F.col("diff") + z * F.col("__se")).alias("ci_high"),
        F.when(F.col("__se") > 0, stats.two_sided_p(F.col("diff") / F.col("__se"))).alias("p_value"),
    )


def effect_histogram(df: DataFrame, effect: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins between the extremes; the last bin is closed."""
    lo, hi = df.agg(F.min(effect)).scalar(), df.agg(F.max(effect)).scalar()
    rows = df.filter(F.col(effect).isNotNull()).select(F.col(effect).alias("x"), lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    no = F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return rows.groupBy(no.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select(
        "bin",
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("high"),
        "n",
    )


# ---- export -------------------------------------------------------------------------------------


def export_filter(
    results: DataFrame, p_threshold: float | None = 0.05, rd_min: float = 0.0, direction: str = "positive",
    min_ess: float | None = None, keep_failed: bool = False,
) -> DataFrame:
    cols = set(results.columns)
    out = results
    if not keep_failed and "status" in cols:
        out = out.filter(F.col("status") == "ok")
    if p_threshold is not None and "p_value" in cols:
        out = out.filter(F.col("p_value") < p_threshold)
    if direction == "positive":
        out = out.filter(F.col("rd") > 0)
    elif direction == "negative":
        out = out.filter(F.col("rd") < 0)
    out = out.filter(F.abs("rd") >= rd_min)
    if min_ess is not None and "ess" in cols:
        out = out.filter(F.col("ess") >= min_ess)
    return out


def dependencies(results: DataFrame, all_effects: bool = True, keys: list[str] | None = None) -> DataFrame:
    """(keys, target, triggers): sorted distinct triggers of each target; without ``all_effects`` only positive ones."""
    rows = results if all_effects else results.filter(F.col("rd") > 0)
    return rows.groupBy(*(keys or []), "target").agg(F.array_sort(F.collect_set("trigger")).alias("triggers"))


def effect_map(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, target, effects): map trigger -> effect, the sparse adjacency of the effect graph."""
    return results.groupBy(*(keys or []), "target").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("trigger", "rd")))).alias("effects")
    )


def summary_statistics(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return results.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("rd").alias("avg_rd"),
        F.stddev_samp("rd").alias("std_rd"),
        F.min("rd").alias("min_rd"),
        F.max("rd").alias("max_rd"),
        F.percentile("rd", F.lit(0.5)).alias("median_rd"),
    )


def export_results(results: DataFrame, out: str, prefix: str = "escalation", keys: list[str] | None = None, **filters) -> dict[str, str]:
    """Writes the filtered summary (CSV), the dependencies (JSON lines) and metadata rows (JSON), per key."""
    kept = export_filter(results, **filters)
    paths = {k: f"{out}/{prefix}_{k}" for k in ("summary", "dependencies", "metadata")}
    plain = [c for c, t in kept.dtypes if not t.startswith(("map", "struct", "array"))]
    kept.select(*plain).write.mode("overwrite").option("header", "true").csv(paths["summary"])
    dependencies(kept, keys=keys).write.mode("overwrite").json(paths["dependencies"])
    params = F.create_map(*[F.lit(str(x)) for kv in filters.items() for x in kv]) if filters else F.lit(None).cast("map<string,string>")
    summary_statistics(kept, keys).withColumn("filter_params", params).write.mode("overwrite").json(paths["metadata"])
    return paths


def edges(results: DataFrame, p_threshold: float = 0.05, min_effect: float = 0.0) -> DataFrame:
    """Directed edges trigger -> target of the significant effects."""
    kept = results.filter((F.col("p_value") < p_threshold) & (F.abs("rd") >= min_effect))
    return kept.select(
        "trigger", "target", F.col("rd").alias("effect"), F.abs("rd").alias("weight"), F.signum("rd").cast("int").alias("sign")
    )


# ---- comparison and chart tables ----------------------------------------------------------------


def screen_with_effects(screen: DataFrame, results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    at = [*(keys or []), "trigger", "target"]
    return screen.join(results.select(*at, "rd", "se", F.col("p_value").alias("rd_p_value")), at)


def compare_runs(standard: DataFrame, other: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs estimated in both runs with the difference of their effects, per key."""
    at = [*(keys or []), "trigger", "target"]

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return ok_rows(df).select(*at, *[F.col(c).alias(f"{c}_{suffix}") for c in ("rd", "ci_low", "ci_high")])

    out = side(standard, "false").join(side(other, "true"), at)
    return out.withColumns({"rd_diff": F.col("rd_true") - F.col("rd_false"), "pair": F.concat("trigger", F.lit(" → "), "target")})


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and correlation."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.corr(x, y).alias("corr"), F.regr_count(y, x).alias("n"),
    )


def effect_matrix(results: DataFrame, targets: list[str], value: str = "rd") -> DataFrame:
    """Trigger x target matrix, zero where there is no estimate."""
    return results.groupBy("trigger").pivot("target", targets).agg(F.first(value)).na.fill(0.0)


def forest_order(results: DataFrame, sort_by: str = "rd") -> DataFrame:
    """Rows for a forest chart with their position."""
    pos = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col(sort_by), "trigger", "target"))  # one row per pair
    return ok_rows(results).select(
        pos.alias("position"), F.concat("trigger", F.lit(" → "), "target").alias("pair"), "rd", "ci_low", "ci_high"
    )


def time_trend(results: DataFrame, time_col: str, keys: list[str] | None = None) -> DataFrame:
    """Estimate with a normal band per time point."""
    keys = keys or ["trigger", "target"]
    return results.select(
        *keys, time_col, "rd", (F.col("rd") - 1.96 * F.col("se")).alias("band_low"), (F.col("rd") + 1.96 * F.col("se")).alias("band_high")
    )


def posterior_ranking(shrunken: DataFrame, threshold: float = 0.95) -> DataFrame:
    pos = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("prob_positive").desc(), "trigger", "target"))
    return shrunken.select(pos.alias("rank"), "trigger", "target", "prob_positive", (F.col("prob_positive") >= threshold).alias("highlight"))


# ---- weights ------------------------------------------------------------------------------------


def weight_summary(df: DataFrame, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Quantiles and effective sample size of a weight column."""
    qs = (0.0, 0.01, 0.5, 0.99, 1.0)
    # equal weights are counted first, so a group is summarised from its distinct values
    cells = df.groupBy(*(keys or []), F.col(weight).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    # null keys are groups too
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    cells = session.checkpoint(cells.withColumn("__group", group))
    out = cells.groupBy("__group", *(keys or [])).agg(stats.kish_ess("w", F.col("n")).alias("ess"), F.sum("n").alias("n"))
    out = out.join(session.small_side(quantiles.weighted(cells, ["__group"], "w", "n", list(qs), "q")), "__group", "left")
    return out.select(*(keys or []), *[F.col("q")[i].alias(f"q{int(q * 100):02d}") for i, q in enumerate(qs)], "ess", "n")


def trim_weights(df: DataFrame, weight: str, lower: float = 1.0, upper: float = 99.0) -> tuple[DataFrame, DataFrame]:
    """Weights clipped at two percentiles, and one row of trim diagnostics."""
    cells = df.groupBy(F.col(weight).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    cells = session.checkpoint(cells)
    bounds = session.checkpoint(quantiles.weighted(cells, [], "w", "n", [lower / 100, upper / 100], "q"))
    lo, hi = bounds.select(F.col("q")[0]).scalar(), bounds.select(F.col("q")[1]).scalar()
    trimmed = df.withColumn("trimmed", F.least(F.greatest(F.col(weight), lo), hi))
    report = cells.select("w", "n", lo.alias("lo"), hi.alias("hi")).agg(
        F.min("w").alias("original_min"), F.max("w").alias("original_max"),
        F.first("lo").alias("trim_lower"), F.first("hi").alias("trim_upper"),
        F.sum(F.when(F.col("w") < F.col("lo"), F.col("n")).otherwise(0)).alias("n_trimmed_lower"),
        F.sum(F.when(F.col("w") > F.col("hi"), F.col("n")).otherwise(0)).alias("n_trimmed_upper"),
    )
    return trimmed, report
