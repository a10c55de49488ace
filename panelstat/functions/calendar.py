"""Calendar and age features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Age bins [lower, upper) with their labels and roll-ups.
AGE_LOWER = [0, 1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95]
AGE_END = 120
BROAD_AGE_GROUPS = [
    (0, "Infants"),
    (1, "Early Childhood"),
    (5, "Late Childhood"),
    (15, "Adolescents & Young Adults"),
    (25, "Early Middle Age"),
    (40, "Late Middle Age"),
    (55, "Pre-Senior"),
    (65, "Early Elderly"),
    (80, "Late Elderly"),
]
AGE_GROUP_OF_BROAD = {
    "Infants": "Pediatric",
    "Early Childhood": "Pediatric",
    "Late Childhood": "Pediatric",
    "Early Middle Age": "Adult",
    "Late Middle Age": "Adult",
    "Pre-Senior": "Adult",
    "Early Elderly": "Elderly",
    "Late Elderly": "Elderly",
}
HIGH_LEVEL_AGE_RANGES = [
    (0, "<15"),
    (15, "15–29"),
    (30, "30–44"),
    (45, "45–59"),
    (60, "60–74"),
    (75, "75–89"),
    (90, "90+"),
]
SEASONS = {1: "Winter", 2: "Spring", 3: "Summer", 4: "Fall"}


def _steps(value: Column, steps: list[tuple[int, str]], end: int = AGE_END) -> Column:
    """Label of the last step at or below value, null outside [first step, end)."""
    out = F.when((value < steps[0][0]) | (value >= end) | value.isNull(), F.lit(None).cast("string"))
    for lower, label in reversed(steps):
        out = out.when(value >= lower, label)
    return out


def age_labels() -> list[tuple[int, str]]:
    """(lower bound, label) for every age bin, derived from the edges."""
    out = []
    for lower, upper in zip(AGE_LOWER, [*AGE_LOWER[1:], None]):
        if upper is None:
            label = f"≥{lower} years"
        elif upper - lower == 1:
            label = f"{lower} years"
        else:
            label = f"{lower}-{upper - 1} years"
        out.append((lower, label))
    return out


def parse_age(c: Column) -> Column:
    """First run of digits in free text; -1 when there is none."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("int"), F.lit(-1))


def age_range(age: Column) -> Column:
    return _steps(age, age_labels())


def broad_age_group(age: Column) -> Column:
    return _steps(age, BROAD_AGE_GROUPS)


def high_level_age_range(age: Column) -> Column:
    return _steps(age, HIGH_LEVEL_AGE_RANGES)


def age_group(age: Column) -> Column:
    """Pediatric, Adult or Elderly; other broad groups keep their own name."""
    broad = broad_age_group(age)
    out = None
    for name in dict.fromkeys(AGE_GROUP_OF_BROAD.values()):
        members = [b for b, g in AGE_GROUP_OF_BROAD.items() if g == name]
        out = F.when(broad.isin(members), name) if out is None else out.when(broad.isin(members), name)
    return out.otherwise(broad)


def age_sort_key(label: Column) -> Column:
    """First number in an age label; labels without one sort last."""
    s = F.trim(label.cast("string"))
    at_least = F.regexp_extract(s, r"≥\s*(\d+)", 1).try_cast("int")
    first = F.regexp_extract(s, r"(\d+)", 1).try_cast("int")
    return F.coalesce(at_least, first, F.lit(10**9))


def calendar_features(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """Year (text), Month, MonthName, YearMonth, SeasonCode, SeasonName; unreadable dates give nulls."""
    ts = F.col(date_col).try_cast("timestamp")
    month = F.month(ts)
    season = F.floor((month % 12) / 3).cast("int") + 1
    season_name = F.element_at(F.create_map(*[F.lit(x) for kv in SEASONS.items() for x in kv]), season)
    return df.withColumns(
        {
            date_col: ts,
            "Year": F.year(ts).cast("string"),
            "Month": month,
            "MonthName": F.date_format(ts, "MMMM"),
            "YearMonth": F.date_format(ts, "yyyy-MM"),
            "SeasonCode": season,
            "SeasonName": F.when(season.isNotNull(), season_name),
        }
    )


def age_features(df: DataFrame, age_col: str = "PatientAge") -> DataFrame:
    """Parsed age plus its range and roll-ups."""
    return df.withColumn(age_col, parse_age(F.col(age_col))).withColumns(
        {
            "AgeRange": age_range(F.col(age_col)),
            "HighLevelAgeRange": high_level_age_range(F.col(age_col)),
            "BroadAgeGroup": broad_age_group(F.col(age_col)),
            "AgeGroup": age_group(F.col(age_col)),
        }
    )
