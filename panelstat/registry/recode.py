"""Recode queries: dictionaries, dates, ages, tokens, flags and per-isolate features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import calendar, stats, text, tokens
from panelstat.operators import panel, recode
from panelstat.registry import base
from panelstat.sources import warehouse


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_of(expr: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def pick(expr: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {sql_text(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {whens} END"


W = warehouse
EXPORT = f"""export AS (
  SELECT o_orderkey AS "IdIsolateDW", o_custkey AS "IdPatientDW",
    CASE WHEN o_orderkey % 97 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "Date",
    {pick(f'o_orderkey % {len(W.PATHOGENS)}', W.PATHOGENS)} AS "Pathogen",
    split_part({pick(f'o_orderkey % {len(W.PATHOGENS)}', W.PATHOGENS)}, ' ', 1) AS "PathogenGenus",
    {pick(f'o_orderkey % {len(W.GROUPS_DE)}', W.GROUPS_DE)} AS "PathogengroupL1",
    {pick(f'o_orderkey % {len(W.MATERIALS_DE) + 1}', W.MATERIALS_DE)} AS "TextMaterialgroupRkiL0",
    {pick(f'o_custkey % {len(W.REGIONS_DE)}', W.REGIONS_DE)} AS "ARS_Region",
    {pick(f'o_orderkey % {len(W.WARDS_DE)}', W.WARDS_DE)} AS "ARS_WardType",
    {pick(f'o_custkey % {len(W.LEVELS_DE) + 1}', W.LEVELS_DE)} AS "ARS_HospitalLevelManual",
    n_name AS "ARS_LabName",
    {pick(f'o_custkey % {len(W.ORGANISATIONS_DE)}', W.ORGANISATIONS_DE)} AS "TypeOrganisation",
    {pick('o_orderkey % 3', ['ambulant', 'stationär', 'teilstationär'])} AS "CareType",
    {pick('o_custkey % 7', ['w', 'm', 'u', 'o', 'd', None, 'x'])} AS "Sex",
    CASE WHEN o_custkey % 50 <> 0 THEN CAST(CAST(floor((c_acctbal + 1000) / 110) AS INTEGER) AS VARCHAR) || ' years' END AS "PatientAge"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def replace_sql(col: str, mapping: dict[str, str]) -> str:
    return case_of(f'"{col}"', mapping, f'"{col}"')


def translate_labels(spark, sf):
    names = spark.createDataFrame([("Escherichia coli", "E. coli"), ("Candida albicans", "C. albicans")], "de string, en string")
    out = recode.translate_export(warehouse.raw_export(spark, sf), names)
    return out.select(
        "IdIsolateDW", "TextMaterialgroupRkiL0", "ARS_Region", "ARS_HospitalLevelManual", "ARS_WardType",
        "PathogengroupL1", "GramType", "PathogenSummary", "Pathogen",
    )


GROUP_EN = replace_sql("PathogengroupL1", recode.PATHOGEN_GROUPS)
TRANSLATED = f"""tr AS (SELECT * REPLACE (
    {replace_sql('TextMaterialgroupRkiL0', recode.MATERIALS)} AS "TextMaterialgroupRkiL0",
    {replace_sql('ARS_Region', recode.REGIONS)} AS "ARS_Region",
    {replace_sql('ARS_HospitalLevelManual', recode.HOSPITAL_LEVELS)} AS "ARS_HospitalLevelManual",
    {replace_sql('ARS_WardType', recode.WARDS)} AS "ARS_WardType",
    {GROUP_EN} AS "PathogengroupL1") FROM export)"""
TRANSLATE_SQL = (
    base.with_(EXPORT, TRANSLATED)
    + """SELECT "IdIsolateDW", "TextMaterialgroupRkiL0", "ARS_Region", "ARS_HospitalLevelManual", "ARS_WardType", "PathogengroupL1",
  CASE WHEN "PathogengroupL1" LIKE 'Gram-negative%' THEN 'Gram-negative' WHEN "PathogengroupL1" LIKE 'Gram-positive%' THEN 'Gram-positive'
    WHEN "PathogengroupL1" IN ('Anaerobes', 'Miscellaneous') THEN "PathogengroupL1" END AS "GramType",
  CASE WHEN contains("PathogengroupL1", ':') THEN trim(split_part("PathogengroupL1", ':', 2)) END AS "PathogenSummary",
  CASE "Pathogen" WHEN 'Escherichia coli' THEN 'E. coli' WHEN 'Candida albicans' THEN 'C. albicans' ELSE "Pathogen" END AS "Pathogen"
FROM tr"""
)


def enrich_categories(spark, sf):
    out = recode.enrich_export(recode.translate_export(warehouse.raw_export(spark, sf)))
    out = out.withColumn("priority_rank", recode.category_rank(F.col("Hospital_Priority"), "Hospital_Priority"))
    return out.select(
        "IdIsolateDW", "hospital_level_group", "Care_Complexity", "Facility_Function", "Hospital_Priority", "priority_rank",
        "OrgType", "PathogenPriority", "Sex", "TextMaterialgroupRkiL0", "CareType",
    )


LEVEL = '"ARS_HospitalLevelManual"'
PRIORITY_CASE = case_of(LEVEL, recode.HOSPITAL_PRIORITY, "'Unclassified'")
PRIO_TEXT = '''coalesce("Pathogen", '') || ' ' || coalesce("PathogenGenus", '')'''
ENRICH_SQL = (
    base.with_(EXPORT, TRANSLATED)
    + f"""SELECT "IdIsolateDW",
  CASE WHEN regexp_matches(coalesce({LEVEL}, ''), 'Level [3-7]') THEN 'Specialized Care' ELSE 'Basic Care' END AS hospital_level_group,
  {case_of(LEVEL, recode.CARE_COMPLEXITY, "'Unknown'")} AS "Care_Complexity",
  {case_of(LEVEL, recode.FACILITY_FUNCTION, "'Unclassified'")} AS "Facility_Function",
  {PRIORITY_CASE} AS "Hospital_Priority",
  CAST(CASE {PRIORITY_CASE} WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS INTEGER) AS priority_rank,
  {case_of('"TypeOrganisation"', recode.ORGANISATIONS, "'Other'")} AS "OrgType",
  CASE WHEN regexp_matches({PRIO_TEXT}, 'Escherichia|Klebsiella|Proteus', 'i') THEN 'Critical'
    WHEN regexp_matches({PRIO_TEXT}, 'Pseudomonas aeruginosa|Staphylococcus aureus', 'i') THEN 'High'
    WHEN regexp_matches({PRIO_TEXT}, 'Streptococcus pneumoniae|Haemophilus influenzae', 'i') THEN 'Medium' ELSE 'Other' END AS "PathogenPriority",
  {case_of('"Sex"', recode.SEX, "'Others'")} AS "Sex",
  {case_of('"TextMaterialgroupRkiL0"', recode.MATERIAL_GROUPS, "'Others'")} AS "TextMaterialgroupRkiL0",
  {case_of('"CareType"', recode.CARE_TYPES, "'Others'")} AS "CareType"
FROM tr"""
)


def calendar_features(spark, sf):
    out = calendar.calendar_features(warehouse.raw_export(spark, sf))
    return out.select("IdIsolateDW", "Date", "Year", "Month", "MonthName", "YearMonth", "SeasonCode", "SeasonName")


CALENDAR_SQL = (
    base.with_(EXPORT)
    + """SELECT "IdIsolateDW", ts AS "Date", CAST(year(ts) AS VARCHAR) AS "Year", CAST(month(ts) AS INTEGER) AS "Month",
  strftime(ts, '%B') AS "MonthName", strftime(ts, '%Y-%m') AS "YearMonth",
  CAST((month(ts) % 12) // 3 + 1 AS INTEGER) AS "SeasonCode",
  CASE (month(ts) % 12) // 3 + 1 WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' WHEN 3 THEN 'Summer' WHEN 4 THEN 'Fall' END AS "SeasonName"
FROM (SELECT "IdIsolateDW", TRY_CAST("Date" AS TIMESTAMP) AS ts FROM export)"""
)


def age_features(spark, sf):
    out = calendar.age_features(warehouse.raw_export(spark, sf))
    return out.select(
        "IdIsolateDW", "PatientAge", "AgeRange", "HighLevelAgeRange", "BroadAgeGroup", "AgeGroup",
        calendar.age_sort_key(F.col("AgeRange")).alias("sort_key"),
    )


def _age_case(steps) -> str:
    whens = " ".join(f"WHEN age >= {lo} THEN {sql_text(label)}" for lo, label in reversed(steps))
    return f"CASE WHEN age < 0 OR age >= 120 THEN NULL {whens} END"


AGE_LABELS_SQL = [(0, "0 years"), (1, "1-4 years")] + [(k, f"{k}-{k + 4} years") for k in range(5, 95, 5)] + [(95, "≥95 years")]
AGE_SQL = (
    base.with_(EXPORT)
    + f"""SELECT "IdIsolateDW", age AS "PatientAge", {_age_case(AGE_LABELS_SQL)} AS "AgeRange",
  {_age_case([(0, '<15'), (15, '15–29'), (30, '30–44'), (45, '45–59'), (60, '60–74'), (75, '75–89'), (90, '90+')])} AS "HighLevelAgeRange",
  {_age_case([(0, 'Infants'), (1, 'Early Childhood'), (5, 'Late Childhood'), (15, 'Adolescents & Young Adults'),
              (25, 'Early Middle Age'), (40, 'Late Middle Age'), (55, 'Pre-Senior'), (65, 'Early Elderly'), (80, 'Late Elderly')])} AS "BroadAgeGroup",
  {_age_case([(0, 'Pediatric'), (15, 'Adolescents & Young Adults'), (25, 'Adult'), (65, 'Elderly')])} AS "AgeGroup",
  CAST(CASE WHEN age < 0 OR age >= 120 THEN 1000000000 WHEN age >= 95 THEN 95 WHEN age = 0 THEN 0 WHEN age < 5 THEN 1 ELSE (age // 5) * 5 END AS INTEGER) AS sort_key
FROM (SELECT "IdIsolateDW", coalesce(TRY_CAST(regexp_extract("PatientAge", '([0-9]+)', 1) AS INTEGER), -1) AS age FROM export)"""
)


def anonymise_labs(spark, sf):
    out = recode.anonymise(warehouse.meta(spark, sf), "lab", "isolate_id")
    return out.groupBy("lab", "Anonymized_Lab").agg(F.count(F.lit(1)).alias("n"))


ANON_SQL = (
    base.with_(base.META)
    + """SELECT lab, 'Lab ' || CAST(row_number() OVER (ORDER BY first_id, lab) AS VARCHAR) AS "Anonymized_Lab", n
FROM (SELECT lab, min(isolate_id) AS first_id, count(*) AS n FROM meta GROUP BY lab)"""
)


def conditional_set(spark, sf):
    df = warehouse.meta(spark, sf).select("isolate_id", "ward", "care_type", "sex")
    df = recode.set_where(df, "sex", "unknown", lambda d: F.coalesce(d.sex.isin("u", "x"), F.lit(True)))
    df = recode.set_where(df, "ward", "ICU", {"ward": "1-URGENT", "care_type": "BUILDING"})
    return recode.map_values(df, "care_type", {"BUILDING": "B", "MACHINERY": "M"}, "other", out="care_short")


SET_SQL = (
    base.with_(base.META)
    + """SELECT isolate_id, CASE WHEN ward = '1-URGENT' AND care_type = 'BUILDING' THEN 'ICU' ELSE ward END AS ward, care_type,
  CASE WHEN sex IS NULL OR sex IN ('u', 'x') THEN 'unknown' ELSE sex END AS sex,
  CASE care_type WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE 'other' END AS care_short FROM meta"""
)


def rename_columns(spark, sf):
    dim = warehouse.table(spark, sf, "part").select(
        F.concat("p_brand", F.lit(" - Drug "), F.split("p_brand", "#")[1]).alias("old"),
        F.concat(F.lit("D"), F.split("p_brand", "#")[1]).alias("new"),
    ).distinct()
    df = recode.rename_from_table(warehouse.raw_export(spark, sf), dim, "old", "new")
    return df.select("IdIsolateDW", "D1", "D7", "D25")


RENAME_SQL = (
    base.with_(base.RAW)
    + """SELECT isolate_id AS "IdIsolateDW", max(raw) FILTER (code = 'Brand#1') AS "D1", max(raw) FILTER (code = 'Brand#7') AS "D7",
  max(raw) FILTER (code = 'Brand#25') AS "D25" FROM raw GROUP BY isolate_id"""
)

# normalised token as SQL; written against column raw
PART = r"regexp_matches(s, '(^|[/\\])\s*{0}\s*($|[/\\])')"
TOKEN = f"""CASE WHEN s IN ('', '.', '-', 'na', 'nan', 'none', 'missing', 'null') THEN NULL
  WHEN s IN ('r', 'res', 'resistant', '1') THEN 'R' WHEN s IN ('s', 'sus', 'susceptible', '0') THEN 'S'
  WHEN s IN ('i', 'int', 'intermediate') THEN 'I'
  WHEN contains(s, '/') OR contains(s, chr(92)) THEN CASE
    WHEN {PART.format('r')} THEN 'R' WHEN {PART.format('i')} THEN 'I' WHEN {PART.format('s')} THEN 'S' END
  WHEN substr(s, 1, 1) IN ('r', 'i', 's') THEN upper(substr(s, 1, 1)) END"""
TOKENS = f"""tok AS (SELECT isolate_id, code, raw, {TOKEN} AS token, CASE WHEN raw IN ('', ' ', 'NA', '-', '.') OR raw IS NULL THEN 0 ELSE 1 END AS tested
  FROM (SELECT *, lower(trim(raw)) AS s FROM raw))"""


def _raw_long(spark, sf):
    export = warehouse.raw_export(spark, sf)
    drugs = {panel.code_of(c): c for c in panel.raw_drug_columns(export.columns)}
    return panel.unpivot_raw(export, drugs, ["IdIsolateDW"])


def result_tokens(spark, sf):
    long = _raw_long(spark, sf).filter(F.col("raw").isNotNull())
    return long.groupBy("raw", tokens.result_token(F.col("raw")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def outcome_schemes(spark, sf):
    t = tokens.result_token(F.col("raw"))
    long = _raw_long(spark, sf).filter(F.col("raw").isNotNull())
    return long.select(
        F.col("IdIsolateDW").alias("isolate_id"), "code",
        tokens.encode_outcome(t, "raw_RSI").alias("raw_rsi"),
        tokens.encode_outcome(t, "RI_vs_S").alias("ri_vs_s"),
        tokens.encode_outcome(t, "R_vs_SI").alias("r_vs_si"),
        tokens.encode_outcome(t, "ordinal_R2I1S0").alias("ordinal"),
    )


SCHEMES_SQL = (
    base.with_(base.RAW, TOKENS)
    + """SELECT isolate_id, upper(code) AS code, token AS raw_rsi,
  CAST(CASE WHEN token IN ('R', 'I') THEN 1 WHEN token = 'S' THEN 0 END AS TINYINT) AS ri_vs_s,
  CAST(CASE WHEN token = 'R' THEN 1 WHEN token IN ('S', 'I') THEN 0 END AS TINYINT) AS r_vs_si,
  CAST(CASE token WHEN 'R' THEN 2 WHEN 'I' THEN 1 WHEN 'S' THEN 0 END AS TINYINT) AS ordinal FROM tok"""
)


def tested_outcome_pairs(spark, sf):
    long = panel.tested_outcome_long(_raw_long(spark, sf))
    return long.select(F.col("IdIsolateDW").alias("isolate_id"), "code", "tested", "outcome")


TESTED_SQL = (
    base.with_(base.RAW, TOKENS)
    + f"""SELECT i.isolate_id, upper(c.code) AS code, CAST(coalesce(t.tested, 0) AS TINYINT) AS tested,
  CASE WHEN t.tested = 1 THEN t.token END AS outcome
FROM (SELECT DISTINCT isolate_id FROM raw) i CROSS JOIN (VALUES {base.CODE_VALUES}) c(code)
LEFT JOIN tok t ON t.isolate_id = i.isolate_id AND t.code = c.code"""
)


def panel_from_raw(spark, sf):
    """In-row variant: wide export to panel arrays, then one summary row per isolate."""
    export = warehouse.raw_export(spark, sf)
    drugs = {panel.code_of(c): c for c in panel.raw_drug_columns(export.columns)}
    df = panel.panel_from_raw(export, drugs, ["IdIsolateDW"])
    return df.select(
        F.col("IdIsolateDW").alias("isolate_id"),
        F.array_join(F.transform("tests", lambda t: t["code"]), ",").alias("codes"),
        F.array_join(F.transform("tests", lambda t: F.coalesce(t["outcome"], F.lit("?"))), "").alias("outcomes"),
    )


PANEL_SQL = (
    base.with_(base.RAW, TOKENS)
    + """SELECT isolate_id, coalesce(string_agg(upper(code), ',' ORDER BY CAST(split_part(code, '#', 2) AS INTEGER)) FILTER (tested = 1), '') AS codes,
  coalesce(string_agg(coalesce(token, '?'), '' ORDER BY CAST(split_part(code, '#', 2) AS INTEGER)) FILTER (tested = 1), '') AS outcomes
FROM tok GROUP BY isolate_id"""
)


def wide_pairs(spark, sf):
    """Panel rows to wide tested/outcome columns of the whole catalogue."""
    drugs = {c: warehouse.drug_column(c) for c in warehouse.CODES}
    out = panel.panel_to_pairs(warehouse.panels(spark, sf), drugs, ["isolate_id"])
    return out.withColumnsRenamed({c: c.replace(" - Drug ", "_").replace("#", "") for c in out.columns})


WIDE_SQL = base.with_(base.TESTS) + "SELECT isolate_id, " + ", ".join(
    f"CAST(count(*) FILTER (code = 'Brand#{k}') AS TINYINT) AS \"Brand{k}_{k}_Tested\", max(outcome) FILTER (code = 'Brand#{k}') AS \"Brand{k}_{k}_Outcome\""
    for k in range(1, len(warehouse.CODES) + 1)
) + " FROM tests GROUP BY isolate_id"


def tested_coercion(spark, sf):
    """Flag texts of the exclusion columns read as tested flags, truthy values and tri-state booleans."""
    m = warehouse.meta(spark, sf)
    long = m.select("isolate_id", F.explode(F.array("excl_screening", "excl_pathogen", "excl_negative")).alias("text"))
    return long.groupBy(
        "text",
        tokens.tested_flag(F.col("text")).cast("int").alias("tested"),
        tokens.truthy(F.col("text")).alias("truthy"),
        tokens.tri_state(F.col("text")).alias("tri_state"),
    ).agg(F.count(F.lit(1)).alias("n"))


COERCE_SQL = (
    base.with_(base.META)
    + """SELECT text, CAST(CASE WHEN lower(trim(text)) IN ('true', '1', 'yes', 't') THEN 1 ELSE 0 END AS INTEGER) AS tested,
  coalesce(lower(trim(text)) IN ('true', '1', 'yes', 't'), false) AS truthy,
  CASE WHEN lower(trim(text)) IN ('true', '1', 'yes', 't') THEN true WHEN lower(trim(text)) IN ('false', '0', 'no') THEN false END AS tri_state,
  count(*) AS n
FROM (SELECT excl_screening AS text FROM meta UNION ALL SELECT excl_pathogen FROM meta UNION ALL SELECT excl_negative FROM meta) GROUP BY 1, 2, 3, 4"""
)


def outcome_normaliser(spark, sf):
    long = _raw_long(spark, sf).filter(F.col("raw").isNotNull())
    return long.groupBy(
        "raw",
        tokens.outcome_token(F.col("raw")).alias("strict"),
        tokens.outcome_token_light(F.col("raw")).alias("light"),
        tokens.resistant_mask(F.col("raw"), "NS_vs_S", False).alias("non_susceptible"),
        tokens.resistant_mask(F.col("raw"), "R_vs_nonR", True).alias("resistant"),
    ).agg(F.count(F.lit(1)).alias("n"))


OUTCOME_SQL = (
    base.with_(base.RAW)
    + """SELECT raw, CASE WHEN s IN ('S', 'I', 'R') THEN s END AS strict, upper(trim(raw)) AS light,
  coalesce(s IN ('R', 'I'), false) AS non_susceptible, coalesce(s = 'R', false) AS resistant, n
FROM (SELECT raw, count(*) AS n, upper(trim(regexp_replace(trim(raw), '[,\\.;:]+$', ''))) AS s FROM raw GROUP BY raw)"""
)


def _inconsistent(spark, sf):
    """Long results in which every seventh isolate claims not to have been tested."""
    return _raw_long(spark, sf).filter(F.col("raw").isNotNull()).select(
        F.col("IdIsolateDW").alias("isolate_id"), "code",
        F.when(F.col("IdIsolateDW") % 7 == 0, "no").otherwise("1.0").alias("tested"), F.col("raw").alias("outcome"),
    )


def consistency_fix(spark, sf):
    return panel.enforce_consistency(_inconsistent(spark, sf))


def consistency_counts(spark, sf):
    return panel.consistency_report(_inconsistent(spark, sf))


STRICT = "CASE WHEN upper(trim(regexp_replace(trim(raw), '[,\\.;:]+$', ''))) IN ('S', 'I', 'R') THEN upper(trim(regexp_replace(trim(raw), '[,\\.;:]+$', ''))) END"
FIX_SQL = (
    base.with_(base.RAW)
    + f"""SELECT isolate_id, upper(code) AS code, CAST(CASE WHEN isolate_id % 7 = 0 THEN 0 ELSE 1 END AS TINYINT) AS tested,
  CASE WHEN isolate_id % 7 <> 0 THEN {STRICT} END AS outcome FROM raw"""
)
FIX_COUNT_SQL = (
    base.with_(base.RAW)
    + f"""SELECT upper(code) AS code, count(*) FILTER (isolate_id % 7 = 0 AND y IS NOT NULL) AS fixed_outcome_to_na,
  CAST(0 AS BIGINT) AS fixed_tested_to_1, count(*) FILTER (y IS NULL) AS n_invalid_mapped_to_na
FROM (SELECT *, {STRICT} AS y FROM raw) GROUP BY code"""
)


def pairing_audit(spark, sf):
    long = panel.tested_outcome_long(_raw_long(spark, sf))
    return panel.pairing_report(long)


PAIRING_SQL = (
    base.with_(base.RAW, TOKENS)
    + f"""SELECT upper(c.code) AS code, CAST(coalesce(sum(tested), 0) AS BIGINT) AS n_tested, count(token) FILTER (tested = 1) AS n_outcome,
  coalesce(sum(tested), 0) > 0 AS has_tested, count(token) FILTER (tested = 1) > 0 AS has_outcome, false AS has_dash
FROM (VALUES {base.CODE_VALUES}) c(code) LEFT JOIN tok t ON t.code = c.code GROUP BY c.code"""
)


def drug_flags(spark, sf):
    df = panel.with_flags(warehouse.panels(spark, sf), codes=warehouse.CODES, recode_mode="NS_vs_S")
    out = panel.flags_wide(df, warehouse.CODES, ["isolate_id"])
    return out.withColumnsRenamed({c: c.replace("#", "") for c in out.columns})


FLAGS_SQL = base.with_(base.TESTS) + "SELECT isolate_id, " + ", ".join(
    f"CAST(count(*) FILTER (code = 'Brand#{k}') AS TINYINT) AS \"Brand{k}_T\", CAST(count(*) FILTER (code = 'Brand#{k}' AND outcome IN ('R', 'I')) AS TINYINT) AS \"Brand{k}_R\""
    for k in range(1, len(warehouse.CODES) + 1)
) + " FROM tests GROUP BY isolate_id"

CLASS_OF = {c: f"class {i % 6}" for i, c in enumerate(warehouse.CODES)}
CATEGORY_OF = {c: ["Access", "Access", "Watch", "Access", "Reserve"][i % 5] for i, c in enumerate(warehouse.CODES)}


def class_features(spark, sf):
    df = panel.class_features(warehouse.panels(spark, sf), CLASS_OF, CATEGORY_OF)
    return df.select(
        "isolate_id", "NumDrugClassesTested", "IsCriticalDrugTested", "BackupDrugsTested",
        panel.panel_depth().alias("panel_depth"),
        panel.panel_depth(["Brand#1", "BRAND#2", "brand#3"]).alias("panel_depth_3"),
        panel.any_outcome("R").alias("any_r"),
    )


CLASS_VALUES = ", ".join(f"('{c}', '{CLASS_OF[c]}', '{CATEGORY_OF[c]}')" for c in warehouse.CODES)
CLASS_SQL = (
    base.with_(base.TESTS)
    + f"""SELECT isolate_id, CAST(count(DISTINCT cls) AS INTEGER) AS "NumDrugClassesTested",
  CAST(max(CASE WHEN cat IN ('Watch', 'Reserve') THEN 1 ELSE 0 END) AS INTEGER) AS "IsCriticalDrugTested",
  CAST(max(CASE WHEN cat = 'Reserve' THEN 1 ELSE 0 END) AS INTEGER) AS "BackupDrugsTested",
  CAST(count(*) AS INTEGER) AS panel_depth, CAST(count(*) FILTER (code IN ('Brand#1', 'Brand#2', 'Brand#3')) AS INTEGER) AS panel_depth_3,
  bool_or(outcome = 'R') AS any_r
FROM tests JOIN (VALUES {CLASS_VALUES}) d(code, cls, cat) USING (code) GROUP BY isolate_id"""
)


def drug_labels(spark, sf):
    label = F.concat("p_brand", F.lit(" - "), "p_name", F.lit("_Tested"))
    parts = text.split_label(F.col("label"))
    return (
        warehouse.table(spark, sf, "part").select("p_partkey", label.alias("label"))
        .select("p_partkey", *[c.alias(n) for n, c in parts.items()], text.normalise_name(F.col("label")).alias("normalised"))
    )


LABEL_SQL = """SELECT p_partkey, p_brand AS abbr, p_name AS full_name, p_brand || ' - ' || p_name AS combined,
  replace(replace(replace(lower(p_brand || ' - ' || p_name || '_Tested'), '/', ''), '-', ''), ' ', '') AS normalised FROM part"""


def clip_and_coerce(spark, sf):
    li = warehouse.table(spark, sf, "lineitem")
    return li.groupBy(
        stats.clip_probability(F.col("l_discount"), 0.02, 0.08).alias("p"),
        stats.numeric_or_zero(warehouse.raw_token()).alias("number"),
    ).agg(F.count(F.lit(1)).alias("n"))


CLIP_SQL = f"""SELECT least(greatest(l_discount, 0.02), 0.08)::DOUBLE AS p, coalesce(TRY_CAST(trim({base.RAW_TOKEN}) AS DOUBLE), 0) AS number, count(*) AS n
FROM lineitem GROUP BY 1, 2"""


QUERIES = {
    "translate_labels": (translate_labels, TRANSLATE_SQL),
    "enrich_categories": (enrich_categories, ENRICH_SQL),
    "calendar_features": (calendar_features, CALENDAR_SQL),
    "age_features": (age_features, AGE_SQL),
    "anonymise_labs": (anonymise_labs, ANON_SQL),
    "conditional_set_and_map": (conditional_set, SET_SQL),
    "rename_from_mapping": (rename_columns, RENAME_SQL),
    "result_tokens": (result_tokens, base.with_(base.RAW, TOKENS) + "SELECT raw, token, count(*) AS n FROM tok GROUP BY raw, token"),
    "outcome_schemes": (outcome_schemes, SCHEMES_SQL),
    "tested_outcome_long": (tested_outcome_pairs, TESTED_SQL),
    "panel_from_raw_export": (panel_from_raw, PANEL_SQL),
    "panel_to_wide_pairs": (wide_pairs, WIDE_SQL),
    "tested_and_boolean_coercion": (tested_coercion, COERCE_SQL),
    "outcome_normalisation": (outcome_normaliser, OUTCOME_SQL),
    "consistency_fix": (consistency_fix, FIX_SQL),
    "consistency_report": (consistency_counts, FIX_COUNT_SQL),
    "pairing_audit": (pairing_audit, PAIRING_SQL),
    "drug_flags": (drug_flags, FLAGS_SQL),
    "class_features": (class_features, CLASS_SQL),
    "drug_label_split": (drug_labels, LABEL_SQL),
    "clip_and_coerce": (clip_and_coerce, CLIP_SQL),
}
