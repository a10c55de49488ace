"""Grouped likelihood models on counted cells: logistic regressions and the testing/resistance
selection model, fitted for all drugs at once.

Every iteration is one Spark aggregate: rows carry only their active features, so the score vector
and the information matrix come from a sparse explode with map-side combining. A task only ever
solves one group's small linear system (coefficients squared), never sees a group's rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat.functions import stats

INTERCEPT = "(Intercept)"
RHO = "rho:atanh"
RHO_BOUND = 0.99

# Ten-point Gauss-Legendre nodes and weights on [-1, 1] (positive half).
GAUSS_NODES = [0.1488743389816312, 0.4333953941292472, 0.6794095682990244, 0.8650633666889845, 0.9739065285171717]
GAUSS_WEIGHTS = [0.2955242247147529, 0.2692667193099963, 0.2190863625159820, 0.1494513491505806, 0.0666713443086881]


def active_features(cell: Column, names: list[str], equation: int = 1, prefix: str = "") -> Column:
    """array<struct<f, x, e>>: intercept and one "covariate=level" indicator per covariate of a cell key."""
    labels = F.array(*[F.lit(f"{prefix}{n}=") for n in names])
    levels = F.transform(F.split(cell, r"\|"), lambda v, i: F.concat(F.element_at(labels, i + 1), v))
    features = F.concat(F.array(F.lit(prefix + INTERCEPT)), levels)
    return F.transform(features, lambda f: F.struct(f.alias("f"), F.lit(1.0).alias("x"), F.lit(equation).alias("e")))


def numeric_features(columns: list[str], names: list[str] | None = None) -> Column:
    """array<struct<f, x, e>> from numeric columns, by their own or the given names; missing counts as zero."""
    items = [F.struct(F.lit(INTERCEPT).alias("f"), F.lit(1.0).alias("x"), F.lit(1).alias("e"))]
    items += [
        F.struct(F.lit(f).alias("f"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x"), F.lit(1).alias("e"))
        for c, f in zip(columns, names or columns)
    ]
    return F.array(*items)


@dataclass(frozen=True)
class Fit:
    """Coefficients per group (group key -> feature -> value); the groups that did not settle."""

    coefficients: dict[tuple, dict[str, float]]
    iterations: int
    unsettled: frozenset[tuple] = frozenset()

    @property
    def converged(self) -> bool:
        return not self.unsettled

    def frame(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, beta map) as a local table of known size."""
        schema = T.StructType(
            [df.schema[k] for k in keys] + [T.StructField("beta", T.MapType(T.StringType(), T.DoubleType()))]
        )
        return df.sparkSession.createDataFrame([(*k, b) for k, b in self.coefficients.items()], schema)


def linear_index(features: Column, beta: Column, equation: int = 1) -> Column:
    used = F.filter(features, lambda t: t["e"] == equation)
    return F.aggregate(used, F.lit(0.0), lambda acc, t: acc + t["x"] * F.coalesce(F.try_element_at(beta, t["f"]), F.lit(0.0)))


def _solver(keys: list[str], current: dict, ridge: float, max_step: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(pdf[k].iloc[0] for k in keys)
        names = sorted(set(pdf["f1"]))
        at = {f: i for i, f in enumerate(names)}
        info, score = np.zeros((len(names), len(names))), np.zeros(len(names))
        for f1, f2, v in zip(pdf["f1"], pdf["f2"], pdf["v"]):
            if f2 == "":
                score[at[f1]] += v
            else:
                info[at[f1], at[f2]] += v
        old = np.array([current.get(key, {}).get(f, 0.0) for f in names])
        penalised = np.array([0.0 if f.endswith(INTERCEPT) or f == RHO else ridge for f in names])
        info = info + np.diag(penalised + 1e-9)
        step = np.linalg.lstsq(info, score - penalised * old, rcond=None)[0]
        size = np.max(np.abs(step)) if len(step) else 0.0
        if size > max_step:
            step = step * (max_step / size)
        out = {k: v for k, v in zip(keys, key)}
        return pd.DataFrame([{**out, "f": f, "b": old[i] + step[i], "step": abs(step[i])} for f, i in at.items()])

    return solve


Stages = list[dict[str, Column]]


def staged(df: DataFrame, stages: Stages) -> DataFrame:
    for columns in stages:
        df = df.withColumns(columns)
    return df


def fit_by_group(cells: DataFrame, keys: list[str], stages: Stages, ridge: float = 1.0, max_iter: int = 25, tol: float = 1e-6, max_step: float = 5.0) -> Fit:
    """Newton-type iterations. ``cells`` has a ``features`` column; the stages add ``g`` (array of
    score sums per equation) and ``h`` (matrix of information sums) given ``beta``.

    Runs one job per iteration; the driver keeps the coefficients, which number groups x features.
    A group leaves the iterations once its own steps are below ``tol``; groups that still move after
    ``max_iter`` are named in the result.
    """
    spark = cells.sparkSession
    key_types = [cells.schema[k] for k in keys]
    beta_schema = T.StructType([*key_types, T.StructField("beta", T.MapType(T.StringType(), T.DoubleType()))])
    out_schema = T.StructType(
        [*key_types, T.StructField("f", T.StringType()), T.StructField("b", T.DoubleType()), T.StructField("step", T.DoubleType())]
    )
    current: dict[tuple, dict[str, float]] = {}
    active: set[tuple] = set()
    i = 0
    gradient = F.struct(F.lit("").alias("f2"), (F.col("a.x") * F.element_at("g", F.col("a.e"))).alias("v"))
    curvature = F.transform(
        "features",
        lambda t: F.struct(
            t["f"].alias("f2"), (F.col("a.x") * t["x"] * F.element_at(F.element_at("h", F.col("a.e")), t["e"])).alias("v")
        ),
    )
    for i in range(1, max_iter + 1):
        if current:
            betas = spark.createDataFrame([(*k, current[k]) for k in active], beta_schema)
            rows = cells.join(betas, keys)
        else:
            rows = cells.withColumn("beta", F.create_map().cast("map<string,double>"))
        first = staged(rows, stages).select(*keys, "features", "g", "h", F.explode("features").alias("a"))
        terms = first.select(*keys, F.col("a.f").alias("f1"), F.inline(F.concat(F.array(gradient), curvature)))
        sums = terms.groupBy(*keys, "f1", "f2").agg(F.sum("v").alias("v"))
        solved = sums.groupBy(*keys).applyInPandas(_solver(keys, current, ridge, max_step), out_schema).collect()
        largest: dict[tuple, float] = {}
        nxt: dict[tuple, dict[str, float]] = {}
        for r in solved:
            key = tuple(r[k] for k in keys)
            nxt.setdefault(key, {})[r["f"]] = r["b"]
            largest[key] = max(largest.get(key, 0.0), r["step"] if np.isfinite(r["step"]) else np.inf)
        current = current | nxt
        active = {k for k, size in largest.items() if not size < tol}
        if not active:
            break
    return Fit(current, i, frozenset(active))


# ---- logistic regression -------------------------------------------------------------------------


def _logit_stages() -> Stages:
    p, n = F.col("__p"), F.col("n").cast("double")
    return [
        {"__p": 1 / (1 + F.exp(-linear_index(F.col("features"), F.col("beta"))))},
        {"g": F.array(F.col("pos") - n * p), "h": F.array(F.array(n * p * (1 - p)))},
    ]


def fit_logit(cells: DataFrame, keys: list[str], ridge: float = 1.0, **kw) -> Fit:
    """Ridge-penalised logistic regression per group from cells (keys, features, n, pos); intercept unpenalised."""
    return fit_by_group(cells, keys, _logit_stages(), ridge, **kw)


def predict_logit(cells: DataFrame, keys: list[str], fit: Fit, out: str = "p") -> DataFrame:
    eta = linear_index(F.col("features"), F.col("beta"))
    return cells.join(fit.frame(cells, keys), keys).withColumn(out, 1 / (1 + F.exp(-eta))).drop("beta")


def testing_cells(df: DataFrame, numeric_columns: list[str], flags_col: str = "flags") -> DataFrame:
    """(code, n, pos, features) per drug and distinct covariate combination: isolates, and those tested.

    Missing covariates count as zero. What is written is one row per combination with an array of
    its tested drugs, never longer than the drug catalogue; the untested drugs of a combination are made while
    it is read, so that rows x drugs are neither stored nor shuffled.
    """
    from panelstat.session import checkpoint

    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(numeric_columns)]
    keys = [f"__x{i}" for i in range(len(x))]
    codes = F.filter(F.transform(F.col(flags_col), lambda t: t["code"]), lambda c: c.isNotNull())
    # the missing code stands for the isolate itself
    items = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(codes, F.array().cast("array<string>")))
    counts = df.select(*x, F.explode(items).alias("code")).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("k"))
    tested = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "k")))
    rows = counts.groupBy(*keys).agg(
        F.max(F.when(F.col("code").isNull(), F.col("k"))).alias("n"), F.map_from_entries(tested).alias("tested")
    )
    rows = checkpoint(rows)
    # once, as the cells are read in every iteration
    catalogue = rows.select(F.explode(F.map_keys("tested")).alias("code")).agg(F.array_sort(F.collect_set("code"))).first()[0]
    cells = rows.withColumn("code", F.explode(F.array(*[F.lit(c) for c in catalogue]).cast("array<string>")))
    return cells.select("code", "n", F.coalesce(F.try_element_at("tested", F.col("code")), F.lit(0)).alias("pos"), numeric_features(keys, numeric_columns).alias("features"))


def positivity(df: DataFrame, numeric_columns: list[str], min_prob: float = 0.01, flags_col: str = "flags") -> DataFrame:
    """Per drug: smallest fitted testing probability among tested isolates, and whether it is too small.

    Rows are counted per distinct covariate combination before anything is fitted. Drugs that are
    always tested are left out.
    """
    cells = testing_cells(df, numeric_columns, flags_col)
    fit = fit_logit(cells, ["code"])
    p = predict_logit(cells, ["code"], fit)
    return p.groupBy("code").agg(
        F.min(F.when(F.col("pos") > 0, F.col("p"))).alias("min_p_tested"), F.sum("pos").alias("n_tested"), F.sum("n").alias("n_rows")
    ).filter(F.col("n_tested") < F.col("n_rows")).withColumn("too_small", F.col("min_p_tested") < min_prob)


# ---- bivariate probit with selection ----------------------------------------------------------


def bivariate_normal_cdf(h: Column, k: Column, rho: Column) -> Column:
    """P(X < h, Y < k) by Gauss-Legendre integration over the correlation angle."""
    angle = F.asin(rho)
    total = F.lit(0.0)
    for x, w in zip(GAUSS_NODES, GAUSS_WEIGHTS):
        for sign in (-1, 1):
            s = F.sin(angle * ((1 + sign * x) / 2))
            total = total + F.lit(w) * F.exp((s * h * k - (h * h + k * k) / 2) / (1 - s * s))
    value = stats.normal_cdf(h) * stats.normal_cdf(k) + angle * total / (4 * np.pi)
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.lit(float(np.sqrt(2 * np.pi)))


def _selection_stages() -> Stages:
    """Score and outer-product information of the three outcomes: untested, tested and resistant, tested and not."""
    floor, zero = F.lit(1e-12), F.lit(0.0)
    theta = F.coalesce(F.try_element_at("beta", F.lit(RHO)), F.lit(0.0))
    indices = {
        "z1": linear_index(F.col("features"), F.col("beta"), 1),
        "z2": linear_index(F.col("features"), F.col("beta"), 2),
        "rho": F.least(F.greatest(F.tanh(theta), F.lit(-RHO_BOUND)), F.lit(RHO_BOUND)),
    }
    z1, z2, rho = F.col("z1"), F.col("z2"), F.col("rho")
    root = F.sqrt(1 - rho * rho)
    probabilities = {
        "P1": stats.normal_cdf(z1),
        "P11": bivariate_normal_cdf(z1, z2, rho),
        "d1": _density(z1) * stats.normal_cdf((z2 - rho * z1) / root),
        "d2": _density(z2) * stats.normal_cdf((z1 - rho * z2) / root),
        "dr": F.exp(-(z1 * z1 - 2 * rho * z1 * z2 + z2 * z2) / (2 * (1 - rho * rho))) / (2 * np.pi * root) * (1 - rho * rho),
        "f1": _density(z1),
    }
    none = F.greatest(1 - F.col("P1"), floor)
    r = F.greatest(F.col("P11"), floor)
    s = F.greatest(F.col("P1") - F.col("P11"), floor)
    scores = {
        "s_untested": F.array(-F.col("f1") / none, zero, zero),
        "s_resistant": F.array(F.col("d1") / r, F.col("d2") / r, F.col("dr") / r),
        "s_other": F.array((F.col("f1") - F.col("d1")) / s, -F.col("d2") / s, -F.col("dr") / s),
    }
    weighted = [(F.col(n).cast("double"), F.col(sc)) for n, sc in (("n_untested", "s_untested"), ("n1", "s_resistant"), ("n0", "s_other"))]
    g = F.array(*[sum((n * sc[i] for n, sc in weighted), zero) for i in range(3)])
    h = F.array(*[F.array(*[sum((n * sc[i] * sc[j] for n, sc in weighted), zero) for j in range(3)]) for i in range(3)])
    return [indices, probabilities, scores, {"g": g, "h": h}]


def selection_features(cell: Column, names: list[str]) -> Column:
    rho = F.array(F.struct(F.lit(RHO).alias("f"), F.lit(1.0).alias("x"), F.lit(3).alias("e")))
    return F.concat(active_features(cell, names, 1, "T:"), active_features(cell, names, 2, "A:"), rho)


def fit_selection(cells: DataFrame, keys: list[str], names: list[str], ridge: float = 1e-3, max_iter: int = 20, tol: float = 1e-3) -> tuple[DataFrame, Fit]:
    """Joint model of testing and resistance with correlated errors, from (keys, cell, n_untested, n1, n0).

    Both equations carry an intercept. Returns the cells with p_test, p_resist_given_tested, rho and
    ``joint``, and the fit. Groups whose joint fit did not settle, or ran into the bound of the
    correlation, take two separate logistic regressions instead (rho = 0, joint false), each group by itself.
    """
    df = cells.withColumn("features", selection_features(F.col("cell"), names))
    stages = _selection_stages()
    fit = fit_by_group(df, keys, stages, ridge, max_iter, tol, max_step=1.0)

    def usable(key: tuple, beta: dict[str, float]) -> bool:
        return key not in fit.unsettled and all(np.isfinite(v) for v in beta.values()) and abs(np.tanh(beta.get(RHO, 0.0))) < RHO_BOUND

    good = {k: b for k, b in fit.coefficients.items() if usable(k, b)}
    frames = []
    if good:
        joined = df.join(Fit(good, fit.iterations).frame(df, keys), keys)
        scored = staged(joined, stages[:2])
        frames.append(
            scored.select(
                *cells.columns,
                F.col("P1").alias("p_test"),
                F.least(F.coalesce(F.try_divide("P11", "P1"), F.lit(0.0)), F.lit(1.0)).alias("p_resist_given_tested"),
                "rho",
                F.lit(True).alias("joint"),
            )
        )
    if len(good) < len(fit.coefficients) or not fit.coefficients:
        rest = {k: {} for k in fit.coefficients.keys() - good.keys()}
        others = cells.join(Fit(rest, 0).frame(cells, keys).select(*keys), keys, "left_semi")
        frames.append(_separate_logits(others, keys, names)[0].withColumn("joint", F.lit(False)))
    return reduce(DataFrame.unionByName, frames), fit


def _separate_logits(cells: DataFrame, keys: list[str], names: list[str]) -> tuple[DataFrame, Fit]:
    nt = F.col("n1") + F.col("n0")
    base = cells.withColumn("features", active_features(F.col("cell"), names))
    testing = base.withColumns({"n": F.col("n_untested") + nt, "pos": nt})
    fit_t = fit_logit(testing, keys)
    out = predict_logit(testing, keys, fit_t, "p_test")
    resist = out.withColumns({"n": nt, "pos": F.col("n1")})
    out = predict_logit(resist, keys, fit_logit(resist, keys), "p_resist_given_tested")
    return out.select(*cells.columns, "p_test", "p_resist_given_tested", F.lit(0.0).alias("rho")), fit_t
