"""Cohort profiles: staged analytical cohort and its tables, for one cohort or all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.functions import tokens
from panelstat.operators import panel, profile, rules

# Covariates that must be present and the profiled dimensions.
REQUIRED_COVARIATES = ["CareType", "ARS_WardType", "Sex", "AgeRange", "AgeGroup"]
DIMENSIONS = ["Year", "TextMaterialgroupRkiL0", "ARS_WardType", "CareType", "AgeRange", "Sex"]
KEEP_NULL = ["AgeRange", "Sex"]
EXPLORER_EXCLUSIONS = ["IsSpecificlyExcluded_Screening", "IsSpecificlyExcluded_Pathogen"]
MIN_PANEL = 3


def cohort_stages(df: DataFrame, definition: rules.RuleSet | None, required: list[str] | None = None, years: tuple[int, int] = rules.COHORT_YEARS) -> list[tuple[str, str, Column]]:
    stages: list[tuple[str, str, Column]] = []
    if definition is not None:
        stages += [(r.column, r.operator, rules.flag(r, df)) for r in definition.rules]
    stages.append(("covariates", "complete", rules.has_covariates(df, required or REQUIRED_COVARIATES)))
    if "Year" in df.columns:
        stages.append(("Year", "between", F.coalesce(tokens.numeric(F.col("Year")).between(*years), F.lit(False))))
    for c in EXPLORER_EXCLUSIONS:
        if c in df.columns:
            stages.append((c, "not_excluded", ~F.coalesce(tokens.tri_state(F.col(c)), F.lit(False))))
    stages.append(("panel", f"at_least_{MIN_PANEL}", panel.panel_depth() >= MIN_PANEL))
    stages.append(("panel", "any_resistant", panel.any_outcome("R")))
    return stages


def profile_cohort(df: DataFrame, definition: rules.RuleSet | None = None, required: list[str] | None = None, years: tuple[int, int] = rules.COHORT_YEARS) -> dict[str, DataFrame]:
    """Lazy tables of one cohort: attrition, value shares, testing, resistance and yearly results.

    Callers that write several of them can persist ``cohort`` first.
    """
    stages = cohort_stages(df, definition, required, years)
    cohort = df
    if definition is not None:
        cohort = rules.apply(cohort, definition)
    for _, _, keep in stages[len(definition.rules) if definition is not None else 0 :]:
        cohort = cohort.filter(keep)
    dims = [c for c in DIMENSIONS if c in df.columns]
    out = {
        "cohort": cohort,
        "attrition": rules.staged_report(df, stages),
        "values": profile.with_age_order(profile.value_shares(cohort, dims, KEEP_NULL)),
        "testing": profile.testing_frequency(cohort, top_n=40),
        "resistance": profile.resistance_table(cohort, top_n=40),
    }
    if "Year" in df.columns:
        out["yearly"] = profile.yearly_results(cohort, "Year", top_n=20, sort_by="pct_r")
    return out


def profile_cohorts(df: DataFrame, cohorts: dict[str, rules.RuleSet] | None = None, required: list[str] | None = None) -> dict[str, DataFrame]:
    """Value shares and drug results of every cohort from one keyed job each."""
    keyed = rules.assign_cohorts(df, cohorts or rules.cohort_rules())
    for _, _, keep in cohort_stages(keyed, None, required):
        keyed = keyed.filter(keep)
    dims = [c for c in DIMENSIONS if c in df.columns]
    return {
        "values": profile.value_shares(keyed, dims, KEEP_NULL, keys=["cohort"]),
        "resistance": profile.with_result_shares(profile.drug_results(keyed, ["cohort"])),
        "prevalence": profile.prevalence(keyed, keys=["cohort"]),
    }


def write_profile(tables: dict[str, DataFrame], out: str) -> None:
    """CSV per table; the cohort is kept in memory while its tables are written."""
    cohort = tables["cohort"].persist()
    try:
        for name, df in tables.items():
            if name != "cohort":
                df.write.mode("overwrite").option("header", "true").csv(f"{out}/{name}")
    finally:
        cohort.unpersist()
