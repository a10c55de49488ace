"""Name normalisation used by the drug-list matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_name(c: Column) -> Column:
    """Lower-cased name without separators, spaces and route suffixes; null becomes empty."""
    s = F.lower(F.trim(c.cast("string")))
    s = F.translate(s, "/- ", "")
    s = F.replace(F.replace(s, F.lit("_iv"), F.lit("")), F.lit("_oral"), F.lit(""))
    return F.coalesce(s, F.lit(""))


def split_label(c: Column) -> dict[str, Column]:
    """Code, full name and both from a "CODE - Name_Tested" label."""
    clean = F.regexp_replace(c, "_Tested$", "")
    parts = F.split(clean, " - ", 2)
    has_code = F.size(parts) == 2
    return {
        "abbr": F.when(has_code, parts[0]).otherwise(clean),
        "full_name": F.when(has_code, parts[1]).otherwise(clean),
        "combined": clean,
    }
