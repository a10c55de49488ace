"""Raw laboratory export to the structured isolate table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat import session
from panelstat.functions import calendar
from panelstat.operators import coverage, panel, recode
from panelstat.sources import readers, writers

# Attribute columns of the structured table, in output order.
META_COLUMNS = [
    "IdIsolateDW", "IdSpecimenDW", "OrgType", "Anonymized_Lab", "IdPatientDW", "Pathogen", "PathogengroupL1", "GramType",
    "Sex", "Date", "PathogenGenus", "TextMaterialgroupRkiL0", "AgeGroup", "AgeRange", "CareType", "ARS_HospitalLevelManual",
    "ARS_WardType", "ARS_Region", "Year", "Month", "MonthName", "YearMonth", "SeasonCode", "SeasonName",
    "TotalAntibioticsTested", "PathogenSummary", "BroadAgeGroup", "HighLevelAgeRange", "Hospital_Priority", "Care_Complexity",
    "Facility_Function", "CSQ", "CSQMG", "CSY", "CSYMG", "IsSpecificlyExcluded_Screening", "TypeOrganisation",
    "IsSpecificlyExcluded_Pathogen", "IsSpecificlyExcluded_PathogenevidenceNegative",
]


@dataclass(frozen=True)
class Structured:
    """Panel rows with attributes, the catalogue {code: column} and the coverage tables."""

    panels: DataFrame
    drugs: dict[str, str]
    coverage_by_test: DataFrame
    coverage_by_outcome: DataFrame
    quality: dict[str, DataFrame]

    def wide(self) -> DataFrame:
        """Tested/outcome column pairs for the drugs that were kept."""
        keep = [c for c in self.panels.columns if c != "tests"]
        return panel.panel_to_pairs(self.panels, self.drugs, keep)


def prepare_export(df: DataFrame, pathogen_names: DataFrame | None = None) -> DataFrame:
    """Translated labels, calendar and age features, grouped categories, anonymised laboratories."""
    df = readers.drop_artifacts(readers.drop_unnamed(readers.require_unique_columns(df)))
    df = recode.translate_export(df, pathogen_names)
    df = calendar.calendar_features(df)
    if "PatientAge" not in df.columns:
        df = df.withColumn("PatientAge", F.col("AgeRange"))
    df = calendar.age_features(df)
    df = recode.enrich_export(df)
    return recode.anonymise(df, "ARS_LabName", "IdIsolateDW")


def structure_export(df: DataFrame, outcome_scheme: str = "raw_RSI", min_ratio: float = 0.01, pathogen_names: DataFrame | None = None) -> Structured:
    """The structured table: panels of isolates with at least one test, rare drugs removed.

    Runs one job over the export, whose panels are kept in the checkpoint folder, and the two
    coverage jobs on them (their results are the drug catalogue).
    """
    drugs = {panel.code_of(c): c for c in panel.raw_drug_columns(df.columns)}
    ready = prepare_export(df, pathogen_names)
    cells = [F.col(f"`{c}`") for c in drugs.values()]
    total = sum((c.isNotNull().cast("int") for c in cells), F.lit(0))
    ready = ready.withColumn("TotalAntibioticsTested", total)
    keep = [c for c in META_COLUMNS if c in ready.columns]
    panels = coverage.keep_tested(session.checkpoint(panel.panel_from_raw(ready, drugs, keep, outcome_scheme)))
    aged = ready.select("IdIsolateDW", "PatientAge")
    by_test = coverage.drug_coverage(panels, min_ratio, codes=list(drugs))
    quality = {
        "without_age": coverage.without_age(aged, "PatientAge"),
        "under_one": coverage.under_one(aged, "PatientAge"),
        "affected_by_test": coverage.affected_rows(panels, by_test).select("IdIsolateDW"),
    }
    panels = coverage.drop_low_coverage(panels, by_test)
    by_outcome = coverage.drug_coverage(panels, min_ratio, by_outcome=True)
    kept = {r["code"] for r in by_outcome.filter(F.col("status") == "Kept").select("code").collect()}  # drug catalogue
    quality["affected_by_outcome"] = coverage.affected_rows(panels, by_outcome, by_outcome=True).select("IdIsolateDW")
    panels = coverage.drop_low_coverage(panels, by_outcome)
    return Structured(panels, {c: n for c, n in drugs.items() if c in kept}, by_test, by_outcome, quality)


def write_structured(result: Structured, base: str, rows_per_file: int = writers.ROWS_PER_FILE) -> dict[str, str]:
    """Wide Parquet table, the panel table, the unique-value lists and the quality tables."""
    wide = result.wide()
    out = {
        "wide": writers.save_flat(wide, f"{base}/structured/dataset_parquet", rows_per_file),
        "panels": writers.save_flat(result.panels, f"{base}/structured/panels", rows_per_file),
    }
    writers.save_unique_values(wide, f"{base}/unique_columns")
    tables = result.quality | {"coverage_by_test": result.coverage_by_test, "coverage_by_outcome": result.coverage_by_outcome}
    for name, table in tables.items():
        out[name] = f"{base}/quality/{name}"
        table.write.mode("overwrite").option("header", "true").csv(out[name])
    return out | {"unique": f"{base}/unique_columns"}


def load_structured(df: DataFrame, strict_codes: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Wide structured table to panel rows with normalised, consistent results."""
    df = readers.drop_artifacts(readers.drop_unnamed(readers.require_unique_columns(df)))
    if "ARS_WardType" in df.columns:
        df = recode.replace_values(df, "ARS_WardType", recode.WARD_HARMONISE)
    drugs = panel.strict_drugs(df.columns) if strict_codes else panel.paired_drugs(df.columns)
    keep = [c for c in df.columns if not c.endswith((panel.TESTED, panel.OUTCOME))]
    return panel.panel_from_pairs(df, drugs, keep), drugs
