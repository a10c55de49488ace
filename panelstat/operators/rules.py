"""Declarative cohort rules: JSON rules compiled to Column predicates, with one-pass attrition reports.

Missing cells compare as the text "nan", so "not equal" and "not in" keep them. Where the column
type and the literal agree the predicate is emitted on the bare column, which lets the scan skip
row groups; otherwise the column is compared as text or number.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat.functions import tokens

OPERATORS = (
    "equals", "not_equals", "in", "not_in", "contains", "regex", "gte", "lte", "gt", "lt",
    "range", "is_true", "is_false", "is_null", "not_null",
)
# How a missing cell may read as text.
MISSING_TEXT = ("nan", "None", "<NA>")


@dataclass(frozen=True)
class Rule:
    column: str
    operator: str
    value: Any = None
    values: tuple = ()
    min: Any = None
    max: Any = None
    case_sensitive: bool = True

    @staticmethod
    def from_dict(d: dict) -> Rule:
        op = d["operator"].lower()
        if op not in OPERATORS:
            raise ValueError(f"Unknown operator: {d['operator']}")
        return Rule(
            d["column"], op, d.get("value"), tuple(d.get("values") or ()), d.get("min"), d.get("max"),
            d.get("case_sensitive", True),
        )

    def to_dict(self) -> dict:
        out: dict[str, Any] = {"column": self.column, "operator": self.operator}
        for key in ("value", "min", "max"):
            if getattr(self, key) is not None:
                out[key] = getattr(self, key)
        if self.values:
            out["values"] = list(self.values)
        if not self.case_sensitive:
            out["case_sensitive"] = False
        return out


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    name: str = "Default"
    description: str = ""
    verbose: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def from_dict(d: dict) -> RuleSet:
        return RuleSet(
            tuple(Rule.from_dict(r) for r in d.get("filters", [])),
            d.get("name", "Default"), d.get("description", ""), d.get("verbose", True),
        )

    @staticmethod
    def from_json(path: str) -> RuleSet:
        return RuleSet.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def to_dict(self) -> dict:
        return {
            "name": self.name,
            "description": self.description,
            "filters": [r.to_dict() for r in self.rules],
            "verbose": self.verbose,
        }

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps(self.to_dict(), indent=2)
        if path:
            Path(path).write_text(text, encoding="utf-8")
        return text


def _as_number(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _text(c: Column, dtype: T.DataType) -> Column:
    """Cell as text; missing reads as "nan"."""
    s = F.initcap(c.cast("string")) if isinstance(dtype, T.BooleanType) else c.cast("string")
    return F.coalesce(s, F.lit(MISSING_TEXT[0]))


def _number(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        return c
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    return tokens.numeric(c)


def _bound(v: float, dtype: T.DataType):
    """Literal in the column's own type where exact, so the comparison reaches the scan."""
    if isinstance(dtype, T.IntegralType) and v == int(v):
        return F.lit(int(v)).cast(dtype)
    return F.lit(v)


def _native_literals(values: list, dtype: T.DataType) -> list | None:
    """Literals for a bare-column comparison, or None when text comparison is needed."""
    if isinstance(dtype, T.StringType):
        texts = [str(v) for v in values]
        return None if any(t in MISSING_TEXT for t in texts) else texts
    if isinstance(dtype, T.IntegralType):
        texts = [str(v) for v in values]
        if all(re.fullmatch(r"-?(0|[1-9]\d*)", t) for t in texts):
            return [int(t) for t in texts]
    return None


def _membership(c: Column, dtype: T.DataType, values: list, case_sensitive: bool) -> Column:
    if case_sensitive:
        native = _native_literals(values, dtype)
        if native is not None:
            return c == native[0] if len(native) == 1 else c.isin(native)
        return _text(c, dtype).isin([str(v) for v in values])
    return F.lower(_text(c, dtype)).isin([str(v).lower() for v in values])


def predicate(rule: Rule, df: DataFrame) -> Column:
    """Filter expression of a rule; null means "drop" (use :func:`flag` for a strict boolean)."""
    if rule.column not in df.columns:
        raise ValueError(f"Column '{rule.column}' not found in dataframe")
    c = F.col(f"`{rule.column}`")
    dtype = df.schema[rule.column].dataType
    op = rule.operator
    if op in ("equals", "not_equals", "in", "not_in"):
        values = [rule.value] if op.endswith("equals") else list(rule.values)
        if not values:
            return F.lit(op == "not_in")
        hit = _membership(c, dtype, values, rule.case_sensitive)
        if not op.startswith("not"):
            return hit
        matches_missing = any(str(v).lower() == "nan" if not rule.case_sensitive else str(v) == "nan" for v in values)
        return ~hit if matches_missing else (c.isNull() | ~hit)
    if op == "contains":
        text, needle = _text(c, dtype), str(rule.value)
        return F.contains(text, F.lit(needle)) if rule.case_sensitive else F.contains(F.lower(text), F.lit(needle.lower()))
    if op == "regex":
        flags = "" if rule.case_sensitive else "(?i)"
        return _text(c, dtype).rlike(f"{flags}^(?:{rule.value})")
    if op in ("gte", "lte", "gt", "lt"):
        bound = _as_number(rule.value)
        if bound is None:  # a non-numeric bound degrades to text equality
            return _text(c, dtype) == str(rule.value)
        x, b = _number(c, dtype), _bound(bound, dtype)
        return {"gte": x >= b, "lte": x <= b, "gt": x > b, "lt": x < b}[op]
    if op == "range":
        lo, hi = _as_number(rule.min), _as_number(rule.max)
        if lo is None or hi is None:
            text = _text(c, dtype)
            return (text >= str(rule.min)) & (text <= str(rule.max))
        x = _number(c, dtype)
        return (x >= _bound(lo, dtype)) & (x <= _bound(hi, dtype))
    if op in ("is_true", "is_false"):
        word, number = ("true", 1) if op == "is_true" else ("false", 0)
        if isinstance(dtype, T.BooleanType):
            return c == (op == "is_true")
        return (F.lower(_text(c, dtype)) == word) | F.coalesce(_number(c, dtype) == number, F.lit(False))
    return c.isNull() if op == "is_null" else c.isNotNull()


def flag(rule: Rule, df: DataFrame) -> Column:
    return F.coalesce(predicate(rule, df), F.lit(False))


def apply(df: DataFrame, rules: RuleSet | list[Rule]) -> DataFrame:
    """Rows that satisfy every rule."""
    rules = rules.rules if isinstance(rules, RuleSet) else rules
    for r in rules:
        df = df.filter(predicate(r, df))
    return df


def staged_report(df: DataFrame, stages: list[tuple[str, str, Column]], keys: list[str] | None = None) -> DataFrame:
    """Attrition of successive (column, operator, strict boolean) stages in a single aggregate.

    One row per stage that still had rows to work on, plus the first.
    """
    keys = keys or []
    names = [f"__s{i}" for i in range(len(stages))]
    staged = df.select(*keys, *[c.alias(n) for n, (_, _, c) in zip(names, stages)])
    aggs, kept = [F.count(F.lit(1)).alias("__n0")], F.lit(True)
    for i, n in enumerate(names):
        kept = kept & F.col(n)
        aggs.append(F.count_if(kept).alias(f"__n{i + 1}"))
    totals = staged.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(column).alias("column"),
                F.lit(operator).alias("operator"),
                F.col(f"__n{i}").alias("n_before"),
                F.col(f"__n{i + 1}").alias("n_after"),
            )
            for i, (column, operator, _) in enumerate(stages)
        ]
    )
    out = totals.select(*keys, F.inline(rows)).filter((F.col("step") == 1) | (F.col("n_before") > 0))
    return out.withColumns(
        {
            "n_removed": F.col("n_before") - F.col("n_after"),
            "pct_retained": F.coalesce(F.try_divide(F.col("n_after") * 100.0, F.col("n_before")), F.lit(0.0)),
        }
    )


def report(df: DataFrame, rules: RuleSet | list[Rule]) -> DataFrame:
    rules = rules.rules if isinstance(rules, RuleSet) else rules
    return staged_report(df, [(r.column, r.operator, flag(r, df)) for r in rules])


# ---- simple filters and exclusions -----------------------------------------------------------


def simple_filters(filters: dict[str, Any]) -> list[Rule]:
    """{column: value or values} as membership rules; missing cells never match."""
    out = []
    for c, v in filters.items():
        values = [v] if isinstance(v, (str, int, float, bool)) else list(v)
        out.append(Rule(c, "in", values=tuple(values)))
    return out


# Default exclusion flags and the convenience filter columns.
EXCLUSION_COLUMNS = [
    "IsSpecificlyExcluded_Screening",
    "IsSpecificlyExcluded_Pathogen",
    "IsSpecificlyExcluded_PathogenevidenceNegative",
]
CONVENIENCE_COLUMNS = ["CSQ", "CSY", "CSQMG", "CSYMG"]


def exclusion_stages(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str, Column]]:
    columns = [c for c in (columns or EXCLUSION_COLUMNS) if c in df.columns]
    return [(c, "drop_truthy", ~tokens.truthy(F.col(c))) for c in columns]


def apply_exclusions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    for _, _, keep in exclusion_stages(df, columns):
        df = df.filter(keep)
    return df


def _convenience_stages(df: DataFrame, convenience: dict[str, Any] | None) -> list[tuple[str, str, Column]]:
    wanted = {c: v for c, v in (convenience or {}).items() if v is not None and c in df.columns}
    return [(r.column, "in", flag(r, df)) for r in simple_filters(wanted)]


def cohort(
    df: DataFrame,
    rules: RuleSet | list[Rule] | None = None,
    filters: dict[str, Any] | None = None,
    convenience: dict[str, Any] | None = None,
    exclusions: list[str] | None = None,
    exclude: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Cohort rows and their attrition report: exclusions, then rules or simple filters, then convenience filters."""
    if rules is not None and filters is not None:
        raise ValueError("Provide only one of: rules, filters.")
    if filters is not None:
        missing = [c for c in filters if c not in df.columns]
        if missing:
            raise ValueError(f"Filter columns not found: {missing}")
        rules = simple_filters(filters)
    rules = list(rules.rules if isinstance(rules, RuleSet) else rules or [])
    stages = exclusion_stages(df, exclusions) if exclude else []
    stages += [(r.column, r.operator, flag(r, df)) for r in rules]
    stages += _convenience_stages(df, convenience)
    # natively typed rules first: they are the ones the scan can use
    kept = apply(df, rules)
    if exclude:
        kept = apply_exclusions(kept, exclusions)
    for _, _, keep in _convenience_stages(df, convenience):
        kept = kept.filter(keep)
    return kept, staged_report(df, stages)


def restrict_pathogens(df: DataFrame, patterns: list[str] | str, column: str = "Pathogen") -> DataFrame:
    """Rows whose pathogen matches any pattern, anywhere, ignoring case."""
    if column not in df.columns:
        raise ValueError(f"Expected '{column}' column not found.")
    pattern = patterns if isinstance(patterns, str) else "|".join(f"(?:{p})" for p in patterns if p)
    return df.filter(F.col(column).rlike(f"(?i){pattern}")) if pattern else df


# Texts that count as a missing covariate.
MISSING_COVARIATE = ["", "nan", "None", "NULL", "null"]


def has_covariates(df: DataFrame, columns: list[str]) -> Column:
    """Strict boolean: none of the present required covariates is missing."""
    ok = F.lit(True)
    for c in columns:
        if c not in df.columns:
            continue
        if isinstance(df.schema[c].dataType, T.StringType):
            ok = ok & F.coalesce(~tokens.strip(F.col(c)).isin(MISSING_COVARIATE), F.lit(False))
        else:
            ok = ok & F.col(c).isNotNull()
    return ok


def drop_missing_covariates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(has_covariates(df, columns))


# ---- cohort definitions ----------------------------------------------------------------------

# Cohort genera with display names, and the shared ward, care and year limits.
GENUS_OF_COHORT = {
    "all": None,
    "escherichia": "Escherichia",
    "klebsiella": "Klebsiella",
    "proteus": "Proteus",
    "pseudomonas": "Pseudomonas",
    "staphylococcus": "Staphylococcus",
    "streptococcus": "Streptococcus",
}
DISPLAY_NAMES = {
    "all": "All Isolates",
    "klebsiella": "Klebsiella pneumoniae",
    "ecoli": "Escherichia coli",
    "pseudomonas": "Pseudomonas aeruginosa",
    "staphylococcus": "Staphylococcus aureus",
    "proteus": "Proteus mirabilis",
    "streptococcus": "Streptococcus pneumoniae",
}
COHORT_WARDS = ["Normal Ward", "Intensive Care Unit", "Outpatient"]
COHORT_CARE = ["In-Patient", "Out-Patient"]
COHORT_YEARS = (2019, 2023)


def cohort_rules(
    genera: dict[str, str | None] | None = None,
    genus_col: str = "PathogenGenus",
    ward_col: str = "ARS_WardType",
    care_col: str = "CareType",
    year_col: str = "Year",
    wards: list[str] | None = None,
    care: list[str] | None = None,
    years: tuple[int, int] = COHORT_YEARS,
) -> dict[str, RuleSet]:
    """The cohort family: one rule set per genus plus "all"."""
    out = {}
    for name, genus in (genera or GENUS_OF_COHORT).items():
        rules = [] if genus is None else [Rule(genus_col, "equals", genus)]
        rules += [
            Rule(ward_col, "in", values=tuple(wards or COHORT_WARDS)),
            Rule(care_col, "in", values=tuple(care or COHORT_CARE)),
            Rule(year_col, "range", min=years[0], max=years[1]),
        ]
        out[name] = RuleSet(tuple(rules), display_name(name))
    return out


def display_name(cohort_name: str) -> str:
    return DISPLAY_NAMES.get(cohort_name, cohort_name.replace("_", " ").title())


def assign_cohorts(df: DataFrame, cohorts: dict[str, RuleSet], out: str = "cohort") -> DataFrame:
    """One row per (row, cohort it belongs to), so all cohorts run as one keyed job."""
    names = []
    for name, rules in cohorts.items():
        member = F.lit(True)
        for r in rules.rules:
            member = member & flag(r, df)
        names.append(F.when(member, F.lit(name)))
    return df.withColumn(out, F.explode(F.array_compact(F.array(*names))))
