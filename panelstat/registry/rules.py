"""Rule queries: every filter operator, attrition reports, cohorts, exclusions and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat import session
from panelstat.functions import tokens
from panelstat.operators import coverage, panel, rules
from panelstat.registry import base
from panelstat.registry.recode import EXPORT, TOKENS, TRANSLATED
from panelstat.operators import recode
from panelstat.sources import warehouse

R = rules.Rule

# rule, SQL condition over meta (nulls read as the text 'nan')
CASES: list[tuple[str, rules.Rule, str]] = [
    ("equals", R("ward", "equals", "2-HIGH"), "ward = '2-HIGH'"),
    ("equals_nocase", R("care_type", "equals", "building", case_sensitive=False), "lower(care_type) = 'building'"),
    ("equals_number", R("year", "equals", 1998), "year = 1998"),
    ("equals_missing", R("sex", "equals", "nan"), "sex IS NULL"),
    ("not_equals", R("sex", "not_equals", "w"), "coalesce(sex, 'nan') <> 'w'"),
    ("in", R("pathogen_group", "in", values=("ASIA", "EUROPE")), "pathogen_group IN ('ASIA', 'EUROPE')"),
    ("in_number", R("year", "in", values=("1996", 1997)), "year IN (1996, 1997)"),
    ("not_in", R("sex", "not_in", values=("w", "m")), "coalesce(sex, 'nan') NOT IN ('w', 'm')"),
    ("not_in_missing", R("sex", "not_in", values=("w", "nan")), "coalesce(sex, 'nan') NOT IN ('w', 'nan')"),
    ("contains", R("care_type", "contains", "HOLD"), "contains(care_type, 'HOLD')"),
    ("contains_nocase", R("ward", "contains", "high", case_sensitive=False), "contains(lower(ward), 'high')"),
    ("contains_missing", R("sex", "contains", "a"), "contains(coalesce(sex, 'nan'), 'a')"),
    ("regex_start", R("ward", "regex", "[12]-"), "regexp_matches(ward, '^(?:[12]-)')"),
    ("regex_mid", R("ward", "regex", "HIGH"), "regexp_matches(ward, '^(?:HIGH)')"),
    ("regex_nocase", R("care_type", "regex", "b|mach", case_sensitive=False), "regexp_matches(care_type, '^(?:b|mach)', 'i')"),
    ("gte", R("year", "gte", "1999"), "year >= 1999"),
    ("lte", R("year", "lte", 1996), "year <= 1996"),
    ("gt", R("excl_screening", "gt", 0), "coalesce(TRY_CAST(trim(excl_screening) AS DOUBLE) > 0, false)"),
    ("lt", R("patient_id", "lt", 100.5), "patient_id < 100.5"),
    ("gte_text_bound", R("care_type", "gte", "BUILDING"), "care_type = 'BUILDING'"),
    ("range", R("year", "range", min=1996, max=1999), "year BETWEEN 1996 AND 1999"),
    ("range_text", R("year_month", "range", min="1996-03", max="1996-09"), "year_month BETWEEN '1996-03' AND '1996-09'"),
    ("is_true", R("excl_pathogen", "is_true"), "coalesce(lower(excl_pathogen) = 'true' OR TRY_CAST(trim(excl_pathogen) AS DOUBLE) = 1, false)"),
    ("is_false", R("excl_pathogen", "is_false"), "coalesce(lower(excl_pathogen) = 'false' OR TRY_CAST(trim(excl_pathogen) AS DOUBLE) = 0, false)"),
    ("is_null", R("sex", "is_null"), "sex IS NULL"),
    ("not_null", R("excl_negative", "not_null"), "excl_negative IS NOT NULL"),
]


def rule_operators(spark, sf):
    """Rows matched by each single rule, all rules in one scan."""
    df = warehouse.meta(spark, sf)
    flags = df.select(*[rules.flag(r, df).alias(n) for n, r, _ in CASES])
    counts = flags.agg(*[F.count_if(F.col(n)).alias(n) for n, _, _ in CASES])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n, _, _ in CASES])
    return counts.select(F.inline(rows))


RULES_SQL = base.with_(base.META) + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) AS n_rows FROM meta WHERE {sql}" for n, _, sql in CASES
)

COHORT = rules.RuleSet(
    (
        R("pathogen_group", "not_equals", "AFRICA"),
        R("ward", "in", values=("1-URGENT", "2-HIGH", "3-MEDIUM")),
        R("care_type", "in", values=("BUILDING", "MACHINERY", "FURNITURE")),
        R("year", "range", min=1996, max=2000),
    ),
    name="four steps",
)
COHORT_CONDS = [
    "pathogen_group <> 'AFRICA'",
    "ward IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "care_type IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
    "year BETWEEN 1996 AND 2000",
]


def cohort_rows(spark, sf):
    """The rule set after a JSON round trip."""
    again = rules.RuleSet.from_dict(__import__("json").loads(COHORT.to_json()))
    return rules.apply(warehouse.meta(spark, sf), again).select("isolate_id", "lab", "ward", "care_type", "year")


COHORT_SQL = base.with_(base.META) + "SELECT isolate_id, lab, ward, care_type, year FROM meta WHERE " + " AND ".join(COHORT_CONDS)


def cohort_report(spark, sf):
    out = rules.report(warehouse.meta(spark, sf), COHORT)
    return out.withColumn("pct_retained", F.round("pct_retained", 6))


def report_sql(frame: str, steps: list[tuple[str, str, str]], ctes: str) -> str:
    """Attrition SQL: successive conditions with column and operator names."""
    parts = []
    for i, (col, op, _) in enumerate(steps):
        before = " AND ".join(f"({c})" for _, _, c in steps[:i]) or "true"
        after = " AND ".join(f"({c})" for _, _, c in steps[: i + 1])
        parts.append(
            f"SELECT CAST({i + 1} AS INTEGER) AS step, '{col}' AS \"column\", '{op}' AS \"operator\", "
            f"count(*) FILTER ({before}) AS n_before, count(*) FILTER ({after}) AS n_after FROM {frame}"
        )
    return (
        ctes
        + 'SELECT step, "column", "operator", n_before, n_after, n_before - n_after AS n_removed, '
        + "round(CASE WHEN n_before > 0 THEN n_after * 100.0 / n_before ELSE 0 END, 6)::DOUBLE AS pct_retained FROM ("
        + " UNION ALL ".join(parts)
        + ") WHERE step = 1 OR n_before > 0"
    )


COHORT_REPORT_SQL = report_sql(
    "meta", [(r.column, r.operator, c) for r, c in zip(COHORT.rules, COHORT_CONDS)], base.with_(base.META)
)

EXCLUDE = ["excl_screening", "excl_pathogen", "excl_negative"]
TRUTHY = "coalesce(TRY_CAST(trim({0}) AS DOUBLE) > 0, coalesce(lower(trim({0})) IN ('true', 'yes', 'y', 't'), false))"
FULL_STEPS = [(c, "drop_truthy", f"NOT {TRUTHY.format(c)}") for c in EXCLUDE] + [
    ("ward", "in", "ward IN ('1-URGENT', '2-HIGH')"),
    ("year", "in", "year IN (1997, 1998)"),
    ("care_type", "in", "care_type = 'BUILDING'"),
]


def _full_cohort(spark, sf):
    return rules.cohort(
        warehouse.meta(spark, sf),
        filters={"ward": ["1-URGENT", "2-HIGH"], "year": ["1997", "1998"]},
        convenience={"care_type": "BUILDING", "absent": "x"},
        exclusions=EXCLUDE,
    )


def cohort_with_exclusions(spark, sf):
    return _full_cohort(spark, sf)[0].select("isolate_id", "ward", "year", "care_type")


def exclusion_report(spark, sf):
    return _full_cohort(spark, sf)[1].withColumn("pct_retained", F.round("pct_retained", 6))


FULL_SQL = base.with_(base.META) + "SELECT isolate_id, ward, year, care_type FROM meta WHERE " + " AND ".join(c for _, _, c in FULL_STEPS)


def pathogen_restriction(spark, sf):
    df = warehouse.raw_export(spark, sf).select("IdIsolateDW", "Pathogen")
    out = rules.restrict_pathogens(df, [r"\bescherichia\b", "pneumoniae", ""])
    return out.groupBy("Pathogen").agg(F.count(F.lit(1)).alias("n"))


def covariate_drop(spark, sf):
    df = warehouse.meta(spark, sf).select("isolate_id", "sex", "age_group", "excl_negative", "year")
    return rules.drop_missing_covariates(df, ["sex", "age_group", "excl_negative", "year", "not_there"])


COVARIATE_SQL = base.with_(base.META) + """SELECT isolate_id, sex, age_group, excl_negative, year FROM meta
WHERE sex IS NOT NULL AND age_group IS NOT NULL AND trim(excl_negative) NOT IN ('', 'nan', 'None', 'NULL', 'null') AND year IS NOT NULL"""


def analysis_cohort(spark, sf):
    """Staged analytical cohort: covariates, years, exclusions, at least three drugs, at least one R."""
    df = warehouse.isolates(spark, sf)
    not_excluded = lambda c: ~F.coalesce(tokens.tri_state(F.col(c)), F.lit(False))
    stages = [
        ("covariates", "complete", rules.has_covariates(df, ["care_type", "ward", "sex", "age_group"])),
        ("year", "between", F.col("year").between(1996, 2000)),
        ("excl_screening", "not_excluded", not_excluded("excl_screening")),
        ("excl_pathogen", "not_excluded", not_excluded("excl_pathogen")),
        ("panel", "at_least_3", panel.panel_depth() >= 3),
        ("panel", "any_resistant", panel.any_outcome("R")),
    ]
    return rules.staged_report(df, stages).withColumn("pct_retained", F.round("pct_retained", 6))


TRI_TRUE = "coalesce(lower(trim({0})) IN ('true', 't', 'yes', 'y', '1'), false)"
ANALYSIS_SQL = report_sql(
    "d",
    [
        ("covariates", "complete", "sex IS NOT NULL AND age_group IS NOT NULL"),
        ("year", "between", "year BETWEEN 1996 AND 2000"),
        ("excl_screening", "not_excluded", f"NOT {TRI_TRUE.format('excl_screening')}"),
        ("excl_pathogen", "not_excluded", f"NOT {TRI_TRUE.format('excl_pathogen')}"),
        ("panel", "at_least_3", "depth >= 3"),
        ("panel", "any_resistant", "n_r > 0"),
    ],
    base.with_(
        base.TESTS, base.META,
        "p AS (SELECT isolate_id, count(*) AS depth, count(*) FILTER (outcome = 'R') AS n_r FROM tests GROUP BY isolate_id)",
        "d AS (SELECT * FROM meta JOIN p USING (isolate_id))",
    ),
)


# Cohort family mapped onto the derived isolates: one per group plus "all"
GENERA = {"all": None, "asia": "ASIA", "europe": "EUROPE", "africa": "AFRICA", "america": "AMERICA", "middle_east": "MIDDLE EAST"}
COHORTS = rules.cohort_rules(
    GENERA, "pathogen_group", "ward", "care_type", "year",
    wards=["1-URGENT", "2-HIGH", "3-MEDIUM"], care=["BUILDING", "MACHINERY", "FURNITURE"], years=(1996, 2000),
)
COHORT_FAMILY_CTE = """cohorts AS (
  SELECT i.*, c.cohort FROM iso i JOIN (VALUES ('all', NULL), ('asia', 'ASIA'), ('europe', 'EUROPE'), ('africa', 'AFRICA'),
    ('america', 'AMERICA'), ('middle_east', 'MIDDLE EAST')) c(cohort, grp) ON c.grp IS NULL OR c.grp = i.pathogen_group
  WHERE ward IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND care_type IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND year BETWEEN 1996 AND 2000)"""


def cohort_family(spark, sf):
    """All cohorts in one keyed job: size, laboratories and months covered."""
    df = rules.assign_cohorts(warehouse.isolates(spark, sf), COHORTS)
    return df.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("lab").alias("n_labs"),
        F.min("year_month").alias("ym_min"),
        F.max("year_month").alias("ym_max"),
        F.sum(panel.panel_depth().cast("long")).alias("n_tests"),
    )


FAMILY_SQL = (
    base.with_(base.TESTS, base.META, base.ISO, COHORT_FAMILY_CTE)
    + """SELECT cohort, count(*) AS n_rows, count(DISTINCT lab) AS n_labs, min(year_month) AS ym_min, max(year_month) AS ym_max,
  CAST(sum((SELECT count(*) FROM tests t WHERE t.isolate_id = c.isolate_id)) AS BIGINT) AS n_tests FROM cohorts c GROUP BY cohort"""
)


# ---- coverage ----------------------------------------------------------------------------------


SHARE_COLUMNS = ["TextMaterialgroupRkiL0", "ARS_HospitalLevelManual", "Sex", "PatientAge", "Date"]


def missing_shares(spark, sf):
    export = warehouse.raw_export(spark, sf)
    cols = [*SHARE_COLUMNS, *[warehouse.drug_column(c) for c in warehouse.CODES]]
    return coverage.missing_shares(export, cols).withColumn("share_missing", F.round("share_missing", 6))


MISSING_SQL = (
    base.with_(base.RAW, EXPORT)
    + " UNION ALL ".join(
        f"""SELECT count(*) AS n_rows, '{c}' AS "column", count(*) - count("{c}") AS n_missing, round((count(*) - count("{c}")) / count(*), 6) AS share_missing FROM export"""
        for c in SHARE_COLUMNS
    )
    + f""" UNION ALL SELECT (SELECT count(*) FROM export), c.code || ' - Drug ' || split_part(c.code, '#', 2), (SELECT count(*) FROM export) - count(raw.code),
  round(1 - count(raw.code) / (SELECT count(*) FROM export), 6) FROM (VALUES {base.CODE_VALUES}) c(code) LEFT JOIN raw ON raw.code = c.code GROUP BY c.code"""
)


def column_pruning(spark, sf):
    """Drug columns with at most 86.8 % missing cells, then rows with any drug left."""
    export = warehouse.raw_export(spark, sf)
    drugs = panel.raw_drug_columns(export.columns)
    kept = coverage.prune_columns(export.select("IdIsolateDW", *drugs), 0.868, drugs)
    left = [c for c in kept.columns if c in drugs]
    out = kept.filter(coverage.has_any(left))
    return out.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(left)))


PRUNE_SQL = (
    base.with_(base.RAW)
    + """, n AS (SELECT count(DISTINCT isolate_id) AS n FROM raw),
kept AS (SELECT code FROM raw, n GROUP BY code, n.n HAVING 1 - count(*) / n.n <= 0.868)
SELECT count(DISTINCT isolate_id) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM kept) AS n_columns FROM raw WHERE code IN (SELECT code FROM kept)"""
)

MIN_RATIO = 0.12


def _export_panels(spark, sf):
    export = warehouse.raw_export(spark, sf)
    drugs = {panel.code_of(c): c for c in panel.raw_drug_columns(export.columns)}
    return panel.panel_from_raw(export, drugs, ["IdIsolateDW", "IdPatientDW", "PatientAge"])


def _tested_panels(spark, sf):
    """Tested panels. All are written once, before the filter, which would encode each panel a second time:
    coverage, its row count and the panels' own use read them."""
    return coverage.keep_tested(session.checkpoint(_export_panels(spark, sf)))


def drug_coverage(spark, sf):
    df = _tested_panels(spark, sf)
    by_test = coverage.drug_coverage(df, MIN_RATIO).withColumn("basis", F.lit("tested"))
    by_outcome = coverage.drug_coverage(df, MIN_RATIO, by_outcome=True).withColumn("basis", F.lit("outcome"))
    return by_test.unionByName(by_outcome)


KEPT_CTES = """tested AS (SELECT * FROM tok WHERE tested = 1),
n AS (SELECT count(DISTINCT isolate_id) AS n FROM tested)"""
COVERAGE_SQL = (
    base.with_(base.RAW, TOKENS, KEPT_CTES)
    + f"""SELECT upper(code) AS code, tested_count, round_even(tested_count / n.n * 100, 2)::DOUBLE AS tested_pct,
  CASE WHEN tested_count / n.n >= {MIN_RATIO} THEN 'Kept' ELSE 'Dropped' END AS status, basis
FROM (SELECT code, count(*) AS tested_count, 'tested' AS basis FROM tested GROUP BY code
      UNION ALL SELECT code, count(token), 'outcome' FROM tested GROUP BY code), n"""
)


def coverage_status(spark, sf):
    df = _tested_panels(spark, sf)
    return coverage.status_shares(coverage.drug_coverage(df, MIN_RATIO))


STATUS_SQL = (
    base.with_(base.RAW, TOKENS, KEPT_CTES)
    + f"""SELECT status, count(*) AS n, round_even(count(*) / sum(count(*)) OVER () * 100, 1)::DOUBLE AS pct
FROM (SELECT code, CASE WHEN count(*) / n.n >= {MIN_RATIO} THEN 'Kept' ELSE 'Dropped' END AS status FROM tested, n GROUP BY code, n.n) GROUP BY status"""
)


def affected_by_dropping(spark, sf):
    df = _tested_panels(spark, sf)
    stats = coverage.drug_coverage(df, MIN_RATIO)
    hit = coverage.affected_rows(df, stats)
    return hit.select(F.col("IdIsolateDW").alias("isolate_id"), F.col("IdPatientDW").alias("patient_id"))


AFFECTED_SQL = (
    base.with_(base.RAW, TOKENS, KEPT_CTES)
    + f"""SELECT DISTINCT t.isolate_id, o_custkey AS patient_id FROM tested t JOIN orders ON o_orderkey = t.isolate_id
WHERE code IN (SELECT code FROM tested, n GROUP BY code, n.n HAVING count(*) / n.n < {MIN_RATIO})"""
)


def low_coverage_panels(spark, sf):
    df = _tested_panels(spark, sf)
    df = coverage.drop_low_coverage(df, coverage.drug_coverage(df, MIN_RATIO))
    return panel.long_tests(df, ["IdIsolateDW"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


LOW_SQL = (
    base.with_(base.RAW, TOKENS, KEPT_CTES)
    + f"SELECT upper(code) AS code, count(*) AS n FROM tested, n GROUP BY code, n.n HAVING count(*) / n.n >= {MIN_RATIO}"
)


def age_quality(spark, sf):
    df = warehouse.raw_export(spark, sf).select("IdIsolateDW", "PatientAge")
    missing = coverage.without_age(df, "PatientAge").withColumn("problem", F.lit("no age"))
    return missing.unionByName(coverage.under_one(df, "PatientAge").withColumn("problem", F.lit("under one")))


AGE_QUALITY_SQL = base.with_(EXPORT) + """SELECT "IdIsolateDW", "PatientAge", CASE WHEN "PatientAge" IS NULL THEN 'no age' ELSE 'under one' END AS problem
FROM export WHERE "PatientAge" IS NULL OR "PatientAge" = '0 years'"""


def unique_values(spark, sf):
    df = recode.translate_export(warehouse.raw_export(spark, sf))
    return coverage.unique_values(df, ["TextMaterialgroupRkiL0", "ARS_Region", "ARS_WardType", "Pathogen", "Sex", "missing"])


UNIQUE_SQL = base.with_(EXPORT, TRANSLATED) + " UNION ALL ".join(
    f"""SELECT DISTINCT '{c}' AS "column", "{c}" AS value FROM tr""" for c in ["TextMaterialgroupRkiL0", "ARS_Region", "ARS_WardType", "Pathogen", "Sex"]
)

QUERIES = {
    "rule_operators": (rule_operators, RULES_SQL),
    "cohort_rows": (cohort_rows, COHORT_SQL),
    "cohort_report": (cohort_report, COHORT_REPORT_SQL),
    "cohort_with_exclusions": (cohort_with_exclusions, FULL_SQL),
    "exclusion_report": (exclusion_report, report_sql("meta", FULL_STEPS, base.with_(base.META))),
    "pathogen_restriction": (
        pathogen_restriction,
        base.with_(EXPORT) + """SELECT "Pathogen", count(*) AS n FROM export WHERE regexp_matches("Pathogen", '\\bescherichia\\b|pneumoniae', 'i') GROUP BY 1""",
    ),
    "covariate_drop": (covariate_drop, COVARIATE_SQL),
    "analysis_cohort_stages": (analysis_cohort, ANALYSIS_SQL),
    "cohort_family": (cohort_family, FAMILY_SQL),
    "missing_shares": (missing_shares, MISSING_SQL),
    "column_pruning": (column_pruning, PRUNE_SQL),
    "drug_coverage": (drug_coverage, COVERAGE_SQL),
    "coverage_status": (coverage_status, STATUS_SQL),
    "affected_by_dropping": (affected_by_dropping, AFFECTED_SQL),
    "low_coverage_panels": (low_coverage_panels, LOW_SQL),
    "age_quality_extracts": (age_quality, AGE_QUALITY_SQL),
    "unique_values": (unique_values, UNIQUE_SQL),
}
