"""Susceptibility tokens, tested flags and boolean-like text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings found in laboratory exports.
RAW_BLANKS = ["", " ", "NA", "-", "."]
TOKEN_MISSING = ["", ".", "-", "na", "nan", "none", "missing", "null"]
TOKEN_R = ["r", "res", "resistant"]
TOKEN_S = ["s", "sus", "susceptible"]
TOKEN_I = ["i", "int", "intermediate"]
OUTCOME_MISSING = ["", " ", "NA", "N/A", "NULL", "NONE", "NAN", "-", "--", "?", "ND", "NOT DONE", "NOTDONE"]
TRUE_WORDS = ["true", "t", "yes", "y"]
FALSE_WORDS = ["false", "f", "no", "n"]

OUTCOME_SCHEMES = ("raw_RSI", "RI_vs_S", "R_vs_SI", "ordinal_R2I1S0")
RECODE_MODES = ("R_vs_nonR", "NS_vs_S")


def strip(c: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.trim(c.cast("string"), F.lit(" \t\n\r\f\x0b"))


def blank_to_null(c: Column) -> Column:
    """The handful of raw blanks that mean "drug not tested"."""
    return F.when(~c.isin(RAW_BLANKS), c)


def result_token(c: Column) -> Column:
    """Raw laboratory text to R, I, S or null; combined results take the worst part (R, I, S)."""
    s = F.lower(strip(c))

    def part(letter: str) -> Column:
        return s.rlike(rf"(^|[\\/])\s*{letter}\s*($|[\\/])")

    combined = F.when(part("r"), "R").when(part("i"), "I").when(part("s"), "S")
    first = F.substring(s, 1, 1)
    return (
        F.when(s.isin(TOKEN_MISSING), F.lit(None).cast("string"))
        .when(s.isin(TOKEN_R) | (s == "1"), "R")
        .when(s.isin(TOKEN_S) | (s == "0"), "S")
        .when(s.isin(TOKEN_I), "I")
        .when(s.rlike(r"[\\/]"), combined)
        .when(first.isin("r", "i", "s"), F.upper(first))
    )


def encode_outcome(token: Column, scheme: str = "raw_RSI") -> Column:
    """Encode a clean R/I/S token; missing stays missing."""
    if scheme == "raw_RSI":
        return token
    if scheme == "RI_vs_S":
        return F.when(token.isin("R", "I"), 1).when(token == "S", 0).cast("tinyint")
    if scheme == "R_vs_SI":
        return F.when(token == "R", 1).when(token.isin("S", "I"), 0).cast("tinyint")
    if scheme == "ordinal_R2I1S0":
        return F.when(token == "R", 2).when(token == "I", 1).when(token == "S", 0).cast("tinyint")
    raise ValueError(f"Unknown outcome scheme: {scheme}")


def numeric(c: Column) -> Column:
    """Number or null, never an error."""
    return strip(c).try_cast("double")


def tested_flag(c: Column) -> Column:
    """0/1 from numbers, booleans or yes/no words; anything unreadable counts as untested."""
    s = F.lower(strip(c))
    value = (
        F.when(s.isin(TRUE_WORDS), F.lit(1.0)).when(s.isin(FALSE_WORDS), F.lit(0.0)).otherwise(numeric(c))
    )
    return F.when(value > 0, 1).otherwise(0).cast("tinyint")


def outcome_token(c: Column) -> Column:
    """Strict S/I/R: trims, drops trailing punctuation, everything else becomes null."""
    s = F.upper(strip(F.regexp_replace(strip(c), r"[,\.;:]+$", "")))
    return F.when(s.isin("S", "I", "R"), s)


def outcome_token_light(c: Column) -> Column:
    """Trim and upper-case only; missing words become the empty string."""
    s = F.upper(strip(c))
    return F.when(s.isNull() | s.isin("NAN", "NONE", "NULL"), "").otherwise(s)


def truthy(c: Column) -> Column:
    """Boolean reading in which a numeric value wins over words and unknown text is false."""
    s = F.lower(strip(c))
    n = numeric(c)
    return F.when(n.isNotNull() & ~F.isnan(n), n > 0).otherwise(F.coalesce(s.isin(TRUE_WORDS), F.lit(False)))


def tri_state(c: Column) -> Column:
    """True, false or null for unknown text."""
    s = F.lower(strip(c))
    return F.when(s.isin([*TRUE_WORDS, "1"]), True).when(s.isin([*FALSE_WORDS, "0"]), False)


def resistant_mask(outcome: Column, recode_mode: str = "R_vs_nonR", drop_i: bool = False) -> Column:
    """Non-null boolean: resistant (or non-susceptible); with drop_i, I never counts as resistant."""
    if recode_mode not in RECODE_MODES:
        raise ValueError(f"recode_mode must be one of {RECODE_MODES}")
    y = outcome_token(outcome)
    hit = ["R"] if recode_mode == "R_vs_nonR" or drop_i else ["R", "I"]
    return F.coalesce(y.isin(hit), F.lit(False))
