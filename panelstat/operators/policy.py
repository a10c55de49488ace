"""Routine testing policy P(target tested | context) and the escalation score.

All drugs are handled in one job. Everything is counted per (context, drug) first; those counters
are all the later steps need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat import session
from panelstat.functions import stats
from panelstat.operators import logistic, quantiles, splits


def context_key(columns: list[str]) -> Column:
    """One text key; missing parts read as NA."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def context_counts(df: DataFrame, context: str, keys: list[str] | None = None, flags_col: str = "flags") -> tuple[DataFrame, DataFrame]:
    """(keys, context, code, n_tested) and (keys, context, n_rows)."""
    keys = keys or []
    tested = df.select(*keys, context, F.explode(F.transform(F.col(flags_col), lambda t: t["code"])).alias("code"))
    return (
        tested.groupBy(*keys, context, "code").agg(F.count(F.lit(1)).alias("n_tested")),
        df.groupBy(*keys, context).agg(F.count(F.lit(1)).alias("n_rows")),
    )


def fit_empirical(tested: DataFrame, rows: DataFrame, context: str, min_context_n: int = 100, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Training tables of the empirical policy from :func:`context_counts` of the training rows.

    Returns (keys, code, p_default) and (keys, context, code, p_context) for contexts of at least
    ``min_context_n`` rows; a large context in which a drug was never tested has probability zero.
    """
    keys = keys or []
    total = rows.groupBy(*keys).agg(F.sum("n_rows").alias("__n"))
    per_code = tested.groupBy(*keys, "code").agg(F.sum("n_tested").alias("__t"))
    if keys:
        default = per_code.join(total, keys)
    else:
        default = per_code.withColumn("__n", total.select("__n").scalar())
    default = default.select(*keys, "code", (F.col("__t") / F.col("__n")).alias("p_default"))
    large = rows.filter(F.col("n_rows") >= min_context_n)
    known = tested.join(large, [*keys, context]).select(
        *keys, context, "code", (F.col("n_tested") / F.col("n_rows")).alias("p_context")
    )
    return default, known


def predict_empirical(
    cells: DataFrame, default: DataFrame, known: DataFrame, large_contexts: DataFrame, context: str,
    min_prob: float = 0.01, keys: list[str] | None = None,
) -> DataFrame:
    """Adds p to (keys, context, code, ...) cells: context share, zero in a large context without a
    test, else the overall share; clipped."""
    keys = keys or []
    large = large_contexts.select(*keys, context, F.lit(True).alias("__large")).distinct()
    out = (
        cells.join(default, [*keys, "code"], "left")
        .join(known, [*keys, context, "code"], "left")
        .join(large, [*keys, context], "left")
    )
    p = F.coalesce(F.col("p_context"), F.when(F.col("__large"), 0.0), F.col("p_default"), F.lit(0.0))
    return out.withColumn("p", stats.clip_probability(p, min_prob, 1 - min_prob)).drop("p_default", "p_context", "__large")


def policy_from_counts(
    tested: DataFrame, rows: DataFrame, cells: DataFrame, context: str, min_context_n: int = 100, min_prob: float = 0.01,
    keys: list[str] | None = None,
) -> DataFrame:
    """Adds p to (keys, context, code, ...) cells from the counters of the training rows."""
    default, known = fit_empirical(tested, rows, context, min_context_n, keys)
    return predict_empirical(cells, default, known, rows.filter(F.col("n_rows") >= min_context_n), context, min_prob, keys)


def empirical_policy(
    train: DataFrame, apply_to: DataFrame, context: str, min_context_n: int = 100, min_prob: float = 0.01,
    keys: list[str] | None = None, flags_col: str = "flags",
) -> DataFrame:
    """(keys, context, code, n_tested, p): tested counters of the applied rows with their routine probability."""
    keys = keys or []
    tested, rows = context_counts(train, context, keys, flags_col)
    cells, _ = context_counts(apply_to, context, keys, flags_col)
    return policy_from_counts(tested, rows, cells, context, min_context_n, min_prob, keys)


STEPS = 10_000  # of a probability in a calibration curve: bounds its points


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing curve through means y with weights n at distinct sorted x.

    Neighbours in the wrong order are pooled; a pool is flat between its ends, pools are joined by lines.
    """
    pools: list[list[float]] = []  # first place, last place, weight, mean
    for i in range(len(x)):
        pools.append([i, i, n[i], y[i]])
        while len(pools) > 1 and pools[-2][3] >= pools[-1][3]:
            _, last, w, m = pools.pop()
            pools[-1][1:] = [last, pools[-1][2] + w, (pools[-1][2] * pools[-1][3] + w * m) / (pools[-1][2] + w)]
    ends = [(x[int(at)], m) for first, last, _, m in pools for at in ((first,) if first == last else (first, last))]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def _curves(keys: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        x, y = isotonic(rows["x"].to_numpy() / STEPS, (rows["pos"] / rows["n"]).to_numpy(float), rows["n"].to_numpy(float))
        return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), x.tolist(), y.tolist()]], columns=[*keys, "xs", "ys"])

    return run


def calibration_curves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xs, ys): isotonic curves of (keys, p, n, pos) rows. Rows are added up per step of p first,
    so that a task sees at most `STEPS` rows of a curve however many it stands for."""
    steps = rows.groupBy(*keys, F.round(F.col("p") * STEPS).cast("int").alias("x"))
    steps = steps.agg(F.sum("n").cast("double").alias("n"), F.sum("pos").cast("double").alias("pos")).filter("n > 0")
    fields = [T.StructField(f.name, f.dataType, True) for f in (rows.schema[k] for k in keys)]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("xs", doubles), T.StructField("ys", doubles)])
    return steps.groupBy(*keys).applyInPandas(_curves(keys), schema)


def on_curve(p: Column, xs: Column, ys: Column) -> Column:
    """The curve's value at p, by the line between its neighbours; flat beyond its ends."""
    x = F.round(p * STEPS) / STEPS
    after = F.size(F.filter(xs, lambda v: v < x)) + 1  # number of the first point at or beyond x
    left = F.greatest(after - 1, F.lit(1))
    right = F.least(after, F.size(xs))
    x0, x1, y0, y1 = (F.element_at(a, at) for a, at in ((xs, left), (xs, right), (ys, left), (ys, right)))
    return F.when(x1 > x0, y0 + (y1 - y0) * (F.least(x, x1) - x0) / (x1 - x0)).otherwise(y1)


def logistic_policy(
    tested: DataFrame, rows: DataFrame, context: str, codes: list[str], folds: int = 3, min_prob: float = 0.01, seed: int = 42,
    keys: list[str] | None = None, calibrate: bool = True,
) -> DataFrame:
    """(keys, context, code, n_rows, n_tested, p): the fitted routine policy of every drug in every context.

    ``tested`` and ``rows`` are the counters of :func:`context_counts`. Contexts are dealt to folds by
    hash; each fold's logistic main-effects model learns from the other folds' contexts and is
    calibrated by an isotonic curve on its own, and a probability is the mean over the folds' models.
    All drugs and folds are fitted together; the result has a row per context and drug. Runs jobs.
    """
    keys = keys or []
    at = [*keys, context]
    every = rows.withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes]))).join(tested, [*at, "code"], "left").na.fill(0, ["n_tested"])
    every = splits.with_fold(every, context, folds, seed + 1).withColumnRenamed(context, "cell")
    cells = session.checkpoint(logistic.cell_rows(every, keys, "code", "n_rows", "n_tested", ["n_rows", "n_tested"], folds=folds))
    model = logistic.fit(cells, keys, codes, folds)
    counted = every.withColumnRenamed("cell", context).select(*at, "code", "n_rows", "n_tested")
    scored = logistic.predict_everywhere(cells, keys, model, "code").withColumnRenamed("cell", context)
    curve = [*keys, "code", "fold"]
    if calibrate:
        held = logistic.predict(cells, keys, model, "code", ["n_rows", "n_tested"])
        curves = calibration_curves(held.select(*curve, "p", F.col("n_rows").alias("n"), F.col("n_tested").alias("pos")), curve)
        # a fold without contexts has no curve
        scored = scored.join(session.small_side(curves), curve, "left")
        scored = scored.withColumn("p", F.when(F.col("xs").isNull(), F.col("p")).otherwise(on_curve(F.col("p"), F.col("xs"), F.col("ys"))))
    mean = scored.groupBy(*at, "code").agg(F.avg("p").alias("p"))
    return counted.join(mean, [*at, "code"]).withColumn("p", stats.clip_probability(F.col("p"), min_prob, 1 - min_prob))


def escalation_scores(policy: DataFrame, trim_percentile: float = 99.0, stabilize: bool = True, keys: list[str] | None = None) -> DataFrame:
    """(…, raw_score, cap, score): 1 / p capped at the percentile among tested rows of the drug.

    The percentile is taken over (score, count) cells with the counts as frequencies; an untested
    row scores zero and needs no row here. Runs jobs: the rows are written once.
    """
    keys = keys or []
    raw = policy.withColumn("raw_score", 1.0 / F.col("p"))
    if not stabilize:
        return raw.withColumns({"cap": F.lit(None).cast("double"), "score": F.col("raw_score")})
    raw = session.checkpoint(raw)
    caps = quantiles.weighted(raw, [*keys, "code"], "raw_score", "n_tested", [trim_percentile / 100.0], "cap")
    caps = session.small_side(caps.withColumn("cap", F.col("cap")[0]))
    return raw.join(caps, [*keys, "code"], "left").withColumn("score", F.least("raw_score", "cap"))


def calibration(cells: DataFrame, n_bins: int = 10, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Brier score and reliability curve per drug from (keys, code, p, n_pos, n_rows) cells."""
    keys = keys or []
    p, pos, n = F.col("p"), F.col("n_pos"), F.col("n_rows")
    brier = cells.groupBy(*keys, "code").agg(
        (F.sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p) / F.sum(n)).alias("brier_score"), F.sum(n).alias("n_rows")
    )
    bin_no = F.greatest(F.ceil(F.round(p * n_bins, 9)) - 1, F.lit(0)).cast("int")
    curve = cells.groupBy(*keys, "code", bin_no.alias("bin")).agg(
        (F.sum(pos) / F.sum(n)).alias("prob_true"), (F.sum(p * n) / F.sum(n)).alias("prob_pred"), F.sum(n).alias("n_rows")
    )
    return brier, curve


def calibration_cells(
    train: DataFrame, validate: DataFrame, context: str, codes: list[str], min_context_n: int = 100, min_prob: float = 0.01,
    keys: list[str] | None = None, flags_col: str = "flags",
) -> DataFrame:
    """(keys, context, code, p, n_pos, n_rows): every context of the validation rows with every drug of the catalogue."""
    keys = keys or []
    train_tested, train_rows = context_counts(train, context, keys, flags_col)
    tested, rows = context_counts(validate, context, keys, flags_col)
    cells = (
        rows.withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes])))
        .join(tested.withColumnRenamed("n_tested", "n_pos"), [*keys, context, "code"], "left")
        .na.fill(0, ["n_pos"])
        .withColumnRenamed("n_rows", "n_valid")
    )
    out = policy_from_counts(train_tested, train_rows, cells, context, min_context_n, min_prob, keys)
    return out.withColumnRenamed("n_valid", "n_rows")
