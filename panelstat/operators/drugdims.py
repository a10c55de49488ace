"""Drug dimension: matching a local drug list to a reference list, and class membership."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat import session
from panelstat.functions.text import normalise_name

# Similarity needed for an approximate match, and the filler for unmatched drugs.
FUZZY_THRESHOLD = 0.80
NOT_SET = "Not Set"
NO_MATCH = "NO MATCH"

MAX_CLOSURE_NAMES = 2_000


def reference_names(reference: DataFrame, name_col: str, order_col: str | None = None) -> DataFrame:
    """(norm, ref_name, ref_order): one entry per normalised name. The last spelling wins, the first sets the order."""
    order = F.col(order_col) if order_col else F.col(name_col)
    rows = reference.select(normalise_name(F.col(name_col)).alias("norm"), F.col(name_col).alias("n"), order.alias("o"))
    return rows.groupBy("norm").agg(F.max_by("n", "o").alias("ref_name"), F.min("o").alias("ref_order"))


def _best_in(names: list[tuple[str, str]]):
    @F.pandas_udf("name string, score double")
    def best(norm: pd.Series) -> pd.DataFrame:
        out = []
        for text in norm:
            top, top_score = None, 0.0
            for candidate, original in names:
                # the cheap upper bounds skip candidates that cannot beat the best so far
                matcher = SequenceMatcher(None, text, candidate)
                if matcher.real_quick_ratio() <= top_score or matcher.quick_ratio() <= top_score:
                    continue
                score = matcher.ratio()
                if score > top_score:
                    top, top_score = original, score
            out.append((top, top_score))
        return pd.DataFrame(out, columns=["name", "score"])

    return best


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _signature(name: str) -> Column:
    """A name's characters, each with its number among equal ones: the signature of its character counts."""
    chars = F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(F.col(name), i, F.lit(1))))
    chars = F.coalesce(chars, F.array().cast("array<string>"))
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def _prefixed(names: DataFrame, name: str, places: Column, threshold: float) -> DataFrame:
    """Names with their signature, rarest entries first, and the prefix of it that any similar name must meet."""
    order = F.array_sort(F.transform(_signature(name), lambda x: F.struct(F.coalesce(F.try_element_at(places, x), F.lit(0).cast("long")).alias("n"), x.alias("x"))))
    out = names.withColumn("__sig", F.transform(order, lambda e: e["x"]))
    # 2M/(a+b) >= t and M <= min(a, b) leave b >= a*t/(2-t), hence M >= a*t/(2-t): all but so many entries, and one
    least = F.ceil(F.size("__sig") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    prefix = F.slice("__sig", F.lit(1), F.size("__sig") - least + 1)
    return out.withColumn("__prefix", F.when(F.size("__sig") == 0, F.array(F.lit(""))).otherwise(prefix))


def similar_pairs(names: DataFrame, ref: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``names`` (norm) and ``ref`` (rnorm) whose similarity reaches the threshold, with their score.

    The similarity 2M/(a+b) counts matching characters, and M is at most the overlap of character counts.
    Pairs meet on a shared prefix entry of their signatures (rarest first) and an admissible length, each
    in its first one only; those whose whole signatures overlap enough reach the matcher. The counts of
    signature entries are one map: characters times their most frequent use in a name.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above zero")
    both = names.select("norm").union(ref.select("rnorm"))
    uses = both.select(F.explode(_signature("norm")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    found = uses.agg(F.map_from_entries(F.collect_list(F.struct("x", "n")))).scalar()
    left = _prefixed(names.withColumn("__uses", found), "norm", F.col("__uses"), threshold).drop("__uses")
    right = _prefixed(ref.withColumn("__uses", found), "rnorm", F.col("__uses"), threshold).drop("__uses")
    shrink = threshold / (2 - threshold)
    a = F.size("__sig")
    lengths = F.sequence(F.ceil(a * shrink - 1e-9).cast("int"), F.floor(a / shrink + 1e-9).cast("int"))
    left = left.select("norm", F.col("__sig").alias("__lsig"), F.col("__prefix").alias("__lprefix"), F.explode("__prefix").alias("__x"), lengths.alias("__lens"))
    left = left.withColumn("__len", F.explode("__lens")).drop("__lens")
    right = right.select(*ref.columns, "__sig", "__prefix", F.explode("__prefix").alias("__x"), F.size("__sig").alias("__len"))
    met = left.join(right, ["__x", "__len"])
    total = F.size("__lsig") + F.size("__sig")
    # array_intersect keeps the left order, in which both prefixes are sorted
    first = F.array_intersect("__lprefix", "__prefix")[0] == F.col("__x")
    enough = 2 * F.size(F.array_intersect("__lsig", "__sig")) >= threshold * total - 1e-9
    met = met.where(first & enough).select("norm", *ref.columns)
    return met.withColumn("score", similarity("norm", "rnorm")).filter(F.col("score") >= threshold)


def fuzzy_matches(unmatched: DataFrame, ref: DataFrame, threshold: float = FUZZY_THRESHOLD, max_closure: int = MAX_CLOSURE_NAMES) -> DataFrame:
    """(norm, fuzzy_name, fuzzy_score) for distinct unmatched names.

    The reference list is a catalogue: up to ``max_closure`` names (checked) travel to the tasks with
    the function. A longer list is matched by :func:`similar_pairs`, which cannot lose a match at or above
    the threshold. The distinct names are written first, or the optimizer moves the matcher below the
    distinct, onto every row; then they are spread over the cluster, as each is long work.
    """
    rows = ref.orderBy("ref_order", "norm").limit(max_closure + 1).collect()
    names = session.checkpoint(unmatched.select("norm").distinct())
    names = names.repartition(names.sparkSession.sparkContext.defaultParallelism, "norm")
    if len(rows) <= max_closure:
        best = _best_in([(r["norm"], r["ref_name"]) for r in rows])
        scored = names.withColumn("m", best("norm"))
        return scored.select("norm", F.col("m.name").alias("fuzzy_name"), F.col("m.score").alias("fuzzy_score")).filter(
            F.col("fuzzy_score") >= threshold
        )
    scored = similar_pairs(names, ref.select(F.col("norm").alias("rnorm"), "ref_name", "ref_order"), threshold)
    best = F.min_by(F.struct("ref_name", "score"), F.struct((-F.col("score")).alias("s"), "ref_order", "rnorm"))
    return scored.groupBy("norm").agg(best.alias("b")).select(
        "norm", F.col("b.ref_name").alias("fuzzy_name"), F.col("b.score").alias("fuzzy_score")
    )


def match_drugs(
    drugs: DataFrame, reference: DataFrame, synonyms: DataFrame, name_col: str = "Antibiotic Name", ref_name_col: str = "Antibiotic",
    ref_columns: list[str] | None = None, order_col: str | None = None, threshold: float = FUZZY_THRESHOLD, class_col: str = "Class",
) -> DataFrame:
    """Left join of a drug list to a reference list: exact name, then synonym, then approximate.

    ``synonyms`` has columns (alias, name). Adds WHO_Match, Match_Type, the reference columns and the
    broad class (all beta-lactams together).
    """
    ref_columns = ref_columns or ["WHO_Class", "WHO_ATC_code", "Category", "Listed_on_EML_2019"]
    ref = reference_names(reference, ref_name_col, order_col)
    alias = synonyms.select(F.col("alias").alias("norm"), normalise_name(F.col("name")).alias("syn_norm")).dropDuplicates(["norm"])
    by_synonym = alias.join(ref.select(F.col("norm").alias("syn_norm"), F.col("ref_name").alias("syn_name")), "syn_norm").select("norm", "syn_name")
    base = drugs.withColumn("norm", normalise_name(F.col(name_col)))
    tiered = base.join(ref.select("norm", "ref_name"), "norm", "left").join(by_synonym, "norm", "left")
    tiered = tiered.withColumn("__perfect", F.coalesce("ref_name", "syn_name")).drop("ref_name", "syn_name")
    if threshold <= 1:
        fuzzy = fuzzy_matches(tiered.filter(F.col("__perfect").isNull()), ref, threshold)
        tiered = tiered.join(fuzzy, "norm", "left")
    else:  # approximate tier switched off
        tiered = tiered.withColumns({"fuzzy_name": F.lit(None).cast("string"), "fuzzy_score": F.lit(None).cast("double")})
    out = tiered.withColumn("WHO_Match", F.coalesce("__perfect", "fuzzy_name", F.lit(NO_MATCH)))
    out = out.withColumn(
        "Match_Type",
        F.when(F.col("__perfect").isNotNull(), "PERFECT")
        .when(F.col("fuzzy_score") == 1.0, "PERFECT")
        .when(F.col("fuzzy_name").isNotNull(), F.format_string("FUZZY(%.2f)", F.col("fuzzy_score")))
        .otherwise("UNMATCHED"),
    ).drop("__perfect", "fuzzy_name", "fuzzy_score", "norm")
    order = F.col(order_col) if order_col else F.col(ref_name_col)
    first = F.row_number().over(W.partitionBy(ref_name_col).orderBy(order))
    facts = reference.withColumn("__rn", first).filter(F.col("__rn") == 1).select(F.col(ref_name_col).alias("WHO_Match"), *ref_columns)
    out = out.join(facts, "WHO_Match", "left").withColumns({c: F.coalesce(F.col(c), F.lit(NOT_SET)) for c in ref_columns})
    if class_col in drugs.columns:
        out = out.withColumn("Broad Class", broad_class(F.col(class_col)))
    return out


def broad_class(c):
    beta = F.contains(c, F.lit("β-lactam")) | F.contains(F.lower(c), F.lit("beta-lactam"))
    return F.when(c.isNull(), NOT_SET).when(beta, "β-lactam").otherwise(c)


def match_report(matched: DataFrame) -> DataFrame:
    kind = F.regexp_replace("Match_Type", r"\(.*\)", "")
    counts = matched.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.bround(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))), 1))


def unmatched_reference(matched: DataFrame, reference: DataFrame, ref_name_col: str = "Antibiotic") -> DataFrame:
    """Reference drugs no local drug was matched to."""
    return reference.select(ref_name_col).distinct().join(
        matched.select(F.col("WHO_Match").alias(ref_name_col)).distinct(), ref_name_col, "left_anti"
    )


# ---- class membership ---------------------------------------------------------------------------


def require_known(dim: DataFrame, column: str, wanted: list[str]) -> None:
    """Raises when a requested class does not exist. Runs a small job on the dimension."""
    known = {r[0] for r in dim.filter(F.col(column).isin(wanted)).select(column).distinct().collect()}
    missing = [w for w in wanted if w not in known]
    if missing:
        raise ValueError(f"Invalid class(es) found: {', '.join(missing)}")


def drugs_of(dim: DataFrame, column: str, wanted: list[str] | str, name_col: str = "Full Name", strict: bool = True) -> DataFrame:
    """Distinct drug names of the wanted classes; unknown classes raise when strict, else are ignored."""
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    if strict:
        require_known(dim, column, wanted)
    return dim.filter(F.col(column).isin(wanted)).select(F.col(column).alias("class"), F.col(name_col).alias("name")).distinct()


def class_map(dim: DataFrame, present: DataFrame, column: str, wanted: list[str] | None = None, name_col: str = "Full Name", suffix: str = "_Tested") -> DataFrame:
    """(class, columns): present drug columns of each class, classes without any are left out.

    ``present`` has one column ``name`` with the drugs that occur in the data.
    """
    rows = dim.filter(F.col(column).isin(wanted)) if wanted is not None else dim.filter(F.col(column).isNotNull())
    named = rows.select(F.col(column).alias("class"), F.col(name_col).alias("name")).join(present.select("name").distinct(), "name", "left_semi")
    return named.groupBy("class").agg(
        F.array_sort(F.collect_set(F.concat("name", F.lit(suffix)))).alias("columns")
    )
