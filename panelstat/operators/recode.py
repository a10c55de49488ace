"""Recoding: conditional sets, dictionary replacement and mapping, renames, derived groups."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelstat import session

# Translations and groupings of the surveillance export.
MATERIALS = {
    "Urin": "Urine", "Wunde": "Wound", "Abstrich": "Swab", "respiratorisch": "Respiratory",
    "Blutkultur": "Blood Culture", "Stuhlproben": "Stool Samples", "Urogenitalabstrich": "Urogenital Swab",
    "Punktat": "Punctate", "sonstiges": "Other", "Ausschluss": "Exclusion", "unbekannt": "Unknown",
}
REGIONS = {
    "West": "West", "Südost": "South East", "Nordost": "North East", "Südwest": "Southwest",
    "Nordwest": "Northwest", "unbekannt": "Unknown",
}
HOSPITAL_LEVELS = {
    "Level 1 - Grundversorgung": "Level 1 - Basic Care",
    "Level 2 - Regelversorgung": "Level 2 - Regular Care",
    "Level 3 - Schwerpunktversorgung": "Level 3 - Specialized Care",
    "Level 4 - Maximalversorgung": "Level 4 - Maximum Care",
    "Level 5 - Fachkrankenhäuser": "Level 5 - Specialized Hospitals",
    "Level 6 - Sonstige Krankenhäuser": "Level 6 - Other Hospitals",
    "Level 7 - Vorsorge- und Rehabilitationseinrichtung": "Level 7 - Preventive and Rehabilitation Facilities",
    "nicht zugeordnet": "Not Assigned",
}
WARDS = {
    "Normalstation": "Normal Ward", "ambulant": "Outpatient", "Intensivstation": "Intensive Care Unit",
    "sonstige Behandlungsart": "Other Treatment Type",
    "Intermediate Care/Wachstation": "Intermediate Care/Awake Station",
    "Rehabilitation": "Rehabilitation", "OP": "Operating Room", "Frührehabilitation": "Early Rehabilitation",
    "unbekannt": "Unknown", "Tagesklinik": "Day Clinic",
}
PATHOGEN_GROUPS = {
    "gram-negativ: Enterobacterales": "Gram-negative: Enterobacterales",
    "gram-positiv: Streptokokken": "Gram-positive: Streptococci",
    "gram-positiv: Staphylokokken": "Gram-positive: Staphylococci",
    "gram-negativ: Nonfermenter": "Gram-negative: Non-fermenters",
    "gram-positiv: andere": "Gram-positive: Other",
    "Anaerobier": "Anaerobes",
    "gram-negativ: andere": "Gram-negative: Other",
    "gram-positiv: Enterokokken": "Gram-positive: Enterococci",
    "sonstige": "Miscellaneous",
}
WARD_HARMONISE = {"Early Rehabilitation": "Rehabilitation", "Rehabilitation": "Rehabilitation"}
SEX = {"w": "Woman", "m": "Man", "u": "Others", "o": "Others", "d": "Others"}
MATERIAL_GROUPS = {
    "Urine": "Urine", "Wound": "Wound", "Swab": "Swab", "Blood Culture": "Blood Culture",
    "Stool Samples": "Stool Samples", "Urogenital Swab": "Urogenital Swab", "Respiratory": "Respiratory",
    "Other": "Others", "Punctate": "Punctate", "Exclusion": "Exclusion", "Unknown": "Others",
}
CARE_TYPES = {"ambulant": "Out-Patient", "stationär": "In-Patient"}
ORGANISATIONS = {"Krankenhaus": "Hospital", "Arztpraxis": "Doctor's office", "Andere": "Other"}
CARE_COMPLEXITY = {
    "Level 1 - Basic Care": "Primary/Secondary",
    "Level 2 - Regular Care": "Primary/Secondary",
    "Level 3 - Specialized Care": "Tertiary & Specialized",
    "Level 4 - Maximum Care": "Tertiary & Specialized",
    "Level 5 - Specialized Hospitals": "Tertiary & Specialized",
    "Level 6 - Other Hospitals": "Other/Peripheral",
    "Level 7 - Preventive and Rehabilitation Facilities": "Preventive/Rehabilitation",
}
FACILITY_FUNCTION = {
    "Level 1 - Basic Care": "General Hospital",
    "Level 2 - Regular Care": "General Hospital",
    "Level 3 - Specialized Care": "Referral/Advanced Hospital",
    "Level 4 - Maximum Care": "Referral/Advanced Hospital",
    "Level 5 - Specialized Hospitals": "Specialized Facility",
    "Level 6 - Other Hospitals": "Other Hospital",
    "Level 7 - Preventive and Rehabilitation Facilities": "Preventive/Rehab Facility",
}
HOSPITAL_PRIORITY = {
    "Level 1 - Basic Care": "Medium",
    "Level 2 - Regular Care": "Medium",
    "Level 3 - Specialized Care": "High",
    "Level 4 - Maximum Care": "High",
    "Level 5 - Specialized Hospitals": "High",
    "Level 6 - Other Hospitals": "Low",
    "Level 7 - Preventive and Rehabilitation Facilities": "Low",
}
# Pathogen priority patterns, tried in this order.
PRIORITY_PATTERNS = {
    "Critical": r"\b(?:Enterobacter|Escherichia|Klebsiella|Citrobacter|Serratia|Proteus|Morganella|Providencia|Acinetobacter baumannii|Mycobacterium)\b",
    "High": r"\b(?:Salmonella Typhi|Shigella spp|Enterococcus faecium|Pseudomonas aeruginosa|Non-typhoidal Salmonella|Neisseria gonorrhoeae|Staphylococcus aureus)\b",
    "Medium": r"\b(?:Group A Streptococci|Streptococcus pneumoniae|Haemophilus influenzae|Group B Streptococci)\b",
}
# Display order of the ordered categories.
CATEGORY_ORDER = {
    "Care_Complexity": ["Primary/Secondary", "Tertiary & Specialized", "Other/Peripheral", "Preventive/Rehabilitation", "Unknown"],
    "Facility_Function": ["General Hospital", "Referral/Advanced Hospital", "Specialized Facility", "Other Hospital", "Preventive/Rehab Facility", "Unclassified"],
    "Hospital_Priority": ["High", "Medium", "Low", "Unclassified"],
    "OrgType": ["Hospital", "Doctor's office", "Other"],
}


def set_where(df: DataFrame, column: str, value, condition: Callable[[DataFrame], Column] | dict | Column) -> DataFrame:
    """Sets ``column`` where the condition holds; a dict means equality on every named column."""
    if isinstance(condition, dict):
        mask = F.lit(True)
        for c, v in condition.items():
            mask = mask & (F.col(c) == v)
    elif isinstance(condition, Column):
        mask = condition
    elif callable(condition):
        mask = condition(df)
    else:
        raise ValueError("condition must be a Column, a function or a dictionary")
    old = F.col(column) if column in df.columns else F.lit(None)
    return df.withColumn(column, F.when(mask, F.lit(value)).otherwise(old))


def lookup(c: Column, mapping: dict[str, str], default: Column | str | None = None) -> Column:
    """Dictionary lookup as an expression. The dictionary is one constant of the plan whatever its size;
    for those of many thousands, :func:`replace_from_table` joins instead."""
    m = F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")
    hit = F.when(c.isNotNull(), F.try_element_at(m, c))
    if default is None:
        return hit
    return F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def replace_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replaces mapped values and keeps the others."""
    if column not in df.columns:
        raise KeyError(f"Column '{column}' not found in data.")
    return df.withColumn(column, lookup(F.col(column), mapping, F.col(column)))


def replace_from_table(df: DataFrame, column: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Like :func:`replace_values` with the dictionary as a table (left join; the optimizer sizes it)."""
    if column not in df.columns:
        raise KeyError(f"Column '{column}' not found in data.")
    dim = table.select(F.col(key).alias("__k"), F.col(value).alias("__v")).dropDuplicates(["__k"])
    joined = df.join(dim, df[column] == F.col("__k"), "left")
    return joined.withColumn(column, F.coalesce("__v", column)).drop("__k", "__v")


def map_values(df: DataFrame, column: str, mapping: dict[str, str], default: str, out: str | None = None) -> DataFrame:
    """Maps a column; unmapped and missing values take the default."""
    return df.withColumn(out or column, lookup(F.col(column), mapping, default))


def rename_from_table(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Renames columns from a (small) mapping table. Runs a job on the table."""
    names = set(df.columns)
    rows = table.select(key, value).filter(F.col(key).isin(sorted(names))).collect()  # at most one row per column
    return df.withColumnsRenamed({r[0]: r[1] for r in rows})


def gram_type(group: Column) -> Column:
    s = F.trim(group)
    return (
        F.when(s.startswith("Gram-negative"), "Gram-negative")
        .when(s.startswith("Gram-positive"), "Gram-positive")
        .when(s == "Anaerobes", "Anaerobes")
        .when(s == "Miscellaneous", "Miscellaneous")
    )


def pathogen_summary(group: Column) -> Column:
    """Text after the colon, null when there is no colon."""
    return F.when(group.contains(":"), F.regexp_extract(group, r":\s*(.*)", 1))


def hospital_level_group(level: Column) -> Column:
    return F.when(F.coalesce(level.rlike(r"\bLevel\s*[3-7]\b"), F.lit(False)), "Specialized Care").otherwise("Basic Care")


def pathogen_priority(*texts: Column) -> Column:
    joined = F.concat_ws(" ", *[F.coalesce(t.cast("string"), F.lit("")) for t in texts])
    out = None
    for name, pattern in PRIORITY_PATTERNS.items():
        hit = joined.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def anonymise(df: DataFrame, column: str, order_by: str, out: str = "Anonymized_Lab", prefix: str = "Lab") -> DataFrame:
    """"Lab i" in order of first appearance by ``order_by``.

    The name table is aggregated map-side before it is ranked, so the ranking sees one row per
    name. Runs the ranking: the names are then attached without moving the rows.
    """
    first = df.groupBy(F.col(column).alias("__name")).agg(F.min(order_by).alias("__first"))
    ranked = first.select(
        "__name",
        F.concat(
            F.lit(f"{prefix} "), F.row_number().over(W.partitionBy(F.lit(1)).orderBy("__first", "__name")).cast("string")
        ).alias(out),
    )
    return df.join(session.small_side(ranked), F.col(column).eqNullSafe(F.col("__name")), "left").drop("__name")


def translate_export(df: DataFrame, pathogen_names: DataFrame | None = None) -> DataFrame:
    """German export labels to English, plus gram type and pathogen summary."""
    plan = {
        "TextMaterialgroupRkiL0": MATERIALS,
        "ARS_Region": REGIONS,
        "ARS_HospitalLevelManual": HOSPITAL_LEVELS,
        "ARS_WardType": WARDS,
        "PathogengroupL1": PATHOGEN_GROUPS,
    }
    present = {c: lookup(F.col(c), m, F.col(c)) for c, m in plan.items() if c in df.columns}
    out = df.withColumns(present)
    out = out.withColumns(
        {"GramType": gram_type(F.col("PathogengroupL1")), "PathogenSummary": pathogen_summary(F.col("PathogengroupL1"))}
    )
    if pathogen_names is not None:
        key, value = pathogen_names.columns[:2]
        out = replace_from_table(out, "Pathogen", pathogen_names, key, value)
    return out


def enrich_export(df: DataFrame) -> DataFrame:
    """Grouped categories of a translated export (sex, material, care, organisation, hospital level)."""
    level = F.col("ARS_HospitalLevelManual")
    return df.withColumns(
        {
            "hospital_level_group": hospital_level_group(level),
            "Care_Complexity": lookup(level, CARE_COMPLEXITY, "Unknown"),
            "Facility_Function": lookup(level, FACILITY_FUNCTION, "Unclassified"),
            "Hospital_Priority": lookup(level, HOSPITAL_PRIORITY, "Unclassified"),
            "OrgType": lookup(F.col("TypeOrganisation"), ORGANISATIONS, "Other"),
            "PathogenPriority": pathogen_priority(F.col("Pathogen"), F.col("PathogenGenus"), F.col("PathogenSummary")),
            "Sex": lookup(F.col("Sex"), SEX, "Others"),
            "TextMaterialgroupRkiL0": lookup(F.col("TextMaterialgroupRkiL0"), MATERIAL_GROUPS, "Others"),
            "CareType": lookup(F.col("CareType"), CARE_TYPES, "Others"),
        }
    )


def category_rank(c: Column, category: str) -> Column:
    """Position of an ordered category, for sorting."""
    ranks = {name: str(i) for i, name in enumerate(CATEGORY_ORDER[category])}
    return lookup(c, ranks).cast("int")
