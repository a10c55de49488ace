"""Pair-effect analysis: discovery screen, estimation, sensitivity, shrinkage and export."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat import session
from panelstat.operators import effects, pairs, panel, post, rules, splits
from panelstat.sources import writers

# Covariates and context of the surveillance table.
COVARIATES = ("Anonymized_Lab", "ARS_WardType", "AgeGroup", "Year")
CONTEXT = ("Anonymized_Lab", "PathogengroupL1", "Year")
TOP_PAIRS = 100


@dataclass(frozen=True)
class Analysis:
    screen: DataFrame
    results: DataFrame
    keys: list[str]


def default_settings() -> effects.EffectSettings:
    return effects.EffectSettings(key="IdIsolateDW", group_col="Anonymized_Lab", covariates=COVARIATES, context=CONTEXT)


def run(
    df: DataFrame, catalogue: list[str], settings: effects.EffectSettings | None = None, top_n: int = TOP_PAIRS,
    keys: list[str] | None = None, joint_selection: bool = False, discovery_share: float = 0.5,
) -> Analysis:
    """Screen on one half of the laboratories, estimate the chosen pairs on the other half.

    ``df`` is a cohort of panel rows; ``keys`` (cohort, year) run several analyses in one plan, each
    with the pairs chosen for it. Runs the screen, which is written and read again.
    """
    s, keys = settings or default_settings(), keys or []
    flagged = panel.with_flags(df, catalogue, drop_i=True)
    halves = splits.group_split(flagged, s.group_col, 1 - discovery_share, s.seed, "is_estimation", keys)
    screened = session.checkpoint(pairs.screen(halves.filter(~F.col("is_estimation")), keys, top_n=top_n))
    if screened.isEmpty():
        raise ValueError("No pairs passed the screen.")
    results = effects.estimate_pairs(halves.filter("is_estimation"), catalogue, s, keys, screened, joint_selection)
    return Analysis(screened, results, keys)


def run_cohorts(df: DataFrame, catalogue: list[str], cohorts: dict[str, rules.RuleSet] | None = None, **kw) -> Analysis:
    """All cohorts as one keyed analysis."""
    return run(rules.assign_cohorts(df, cohorts or rules.cohort_rules()), catalogue, keys=["cohort"], **kw)


def write(analysis: Analysis, out: str, settings: effects.EffectSettings) -> dict[str, str]:
    """Results with manifest, filtered export, shrinkage, failures, screen beside effect, and the
    sensitivity of the strongest pair, each per key."""
    paths = writers.save_results(analysis.results, out, asdict(settings))
    results = analysis.results.sparkSession.read.option("header", "true").option("inferSchema", "true").csv(paths["results"])
    keys = analysis.keys
    paths |= post.export_results(results, f"{out}/export", keys=keys, p_threshold=0.05)
    tables = {
        "shrinkage": post.shrink(results, keys),
        "failed": results.filter(F.col("status") == "failed").select(*keys, "trigger", "target", "skip_reason", "n_A1", "n_A0"),
        "screen_vs_effect": post.screen_with_effects(
            analysis.screen.select(*keys, "trigger", "target", "or_unadjusted", "q_value"), post.ok_rows(results), keys
        ),
        "sensitivity": post.robustness(post.strongest_pair(results, keys), F.col("n_used") - 2).drop("diagnostics"),
    }
    for name, table in tables.items():
        paths[name] = f"{out}/{name}"
        plain = [c for c, t in table.dtypes if not t.startswith(("map", "struct", "array"))]
        table.select(*plain).write.mode("overwrite").option("header", "true").csv(paths[name])
    return paths


def compare_testing_models(
    df: DataFrame, catalogue: list[str], cohorts: dict[str, rules.RuleSet] | None = None, out: str | None = None, **kw
) -> DataFrame:
    """Every cohort estimated with the standard and with the joint testing/resistance model, side by side.

    With ``out`` the comparison is written there as CSV and read back.
    """
    standard, joint = (run_cohorts(df, catalogue, cohorts, joint_selection=j, **kw) for j in (False, True))
    table = post.compare_runs(standard.results, joint.results, ["cohort"])
    if out is None:
        return table
    table.write.mode("overwrite").option("header", "true").csv(out)
    return df.sparkSession.read.schema(table.schema).option("header", "true").csv(out)


def reestimate_by_year(df: DataFrame, analysis: Analysis, catalogue: list[str], settings: effects.EffectSettings, year_col: str = "Year") -> DataFrame:
    """The chosen pairs once more for each year, as one keyed plan."""
    flagged = panel.with_flags(df, catalogue, drop_i=True)
    chosen = analysis.screen.select(*[k for k in analysis.keys if k in df.columns], "trigger", "target")
    keys = [*[k for k in analysis.keys if k in df.columns], year_col]
    within = replace(settings, covariates=tuple(c for c in settings.covariates if c != year_col), context=tuple(c for c in settings.context if c != year_col))
    return effects.estimate_pairs(flagged, catalogue, within, keys, chosen)
