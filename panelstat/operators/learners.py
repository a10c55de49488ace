"""Spark ML estimators on counted cells: estimator menu, calibration, cross-fitting, ML policy, effect learners.

Covariates are categorical, so models are trained on distinct covariate cells weighted by their
counts: the training set does not grow with the number of isolates.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat import session
from panelstat.functions import stats
from panelstat.operators import splits

# Defaults of the estimator menu.
FOREST = {"numTrees": 400, "maxDepth": 8}
BOOST = {"maxIter": 400, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
MIN_LEAF = 20
PARALLEL_FITS = 4


def encoder(columns: list[str]) -> Pipeline:
    """One-hot encoding of text covariates; unseen levels become all zeros."""
    indexed, hot = [f"__i_{c}" for c in columns], [f"__h_{c}" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
            VectorAssembler(inputCols=hot, outputCol="features"),
        ]
    )


def text_covariates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns})


def build(model_type: str, task: str = "classification", seed: int = 42, weight_col: str = "n", label_col: str = "label", **params) -> Estimator:
    """"logit", "rf" or "xgb" (boosted trees) for classification or regression."""
    common = {"featuresCol": "features", "labelCol": label_col, "weightCol": weight_col}
    classify = task == "classification"
    if model_type == "logit":
        if classify:
            return LogisticRegression(**common, maxIter=params.get("maxIter", 100), regParam=params.get("regParam", 0.0))
        return LinearRegression(**common, maxIter=100, regParam=params.get("regParam", 1e-9))
    if model_type == "rf":
        cls = RandomForestClassifier if classify else RandomForestRegressor
        return cls(**common, seed=seed, **{**FOREST, **params})
    if model_type == "xgb":
        cls = GBTClassifier if classify else GBTRegressor
        return cls(**common, seed=seed, **{**BOOST, **params})
    raise ValueError(f"Unsupported model_type={model_type} for task={task}")


def positive_class(df: DataFrame) -> Column:
    return vector_to_array(F.col("probability"))[1] if "probability" in df.columns else F.col("prediction")


def _scored(model, df: DataFrame, out: str) -> DataFrame:
    t = model.transform(df)
    return t.withColumn(out, positive_class(t)).select(*df.columns, out)


def _log_odds(score: str) -> Column:
    p = F.least(F.greatest(score, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(p / (1 - p))


class Calibrated:
    """Average of inner-fold models, each calibrated (isotonic or sigmoid) on the rows it did not see.

    Inner folds hash the given key, so equal keys always share a fold.
    """

    def __init__(self, make: Callable[[], Estimator], key: str, method: str = "isotonic", folds: int = 3, seed: int = 42, label_col: str = "label", weight_col: str = "n"):
        self.make, self.key, self.method, self.folds, self.seed = make, key, method, folds, seed
        self.label_col, self.weight_col = label_col, weight_col

    def fit(self, df: DataFrame) -> Calibrated:
        inner = splits.with_fold(df, self.key, self.folds, self.seed + 1, "__inner")

        def one(k: int):
            base = self.make().fit(inner.filter(F.col("__inner") != k))
            held = session.checkpoint(_scored(base, inner.filter(F.col("__inner") == k), "__s"))
            if self.method == "isotonic":
                cal = IsotonicRegression(featuresCol="__s", labelCol=self.label_col, weightCol=self.weight_col, predictionCol="__c").fit(held)
            else:
                logit = _log_odds("__s")
                held = VectorAssembler(inputCols=["__l"], outputCol="__f").transform(held.withColumn("__l", logit))
                cal = LogisticRegression(featuresCol="__f", labelCol=self.label_col, weightCol=self.weight_col, predictionCol="__d", probabilityCol="__q", rawPredictionCol="__w").fit(held)
            return base, cal

        self.models = [one(k) for k in range(self.folds)]
        return self

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Writes each model's scores before its calibration and before the next one's, so that no task's
        closure holds two models."""
        cols = []
        for i, (base, cal) in enumerate(self.models):
            df = session.checkpoint(_scored(base, df, "__s"))
            if self.method == "isotonic":
                df = cal.transform(df).withColumnRenamed("__c", f"__c{i}").drop("__s")
            else:
                logit = _log_odds("__s")
                t = cal.transform(VectorAssembler(inputCols=["__l"], outputCol="__f").transform(df.withColumn("__l", logit)))
                df = t.withColumn(f"__c{i}", vector_to_array(F.col("__q"))[1]).drop("__s", "__l", "__f", "__d", "__q", "__w")
            df = session.checkpoint(df)
            cols.append(f"__c{i}")
        return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / len(cols)).drop(*cols)


def cross_fit(
    df: DataFrame, make: Callable[[], Estimator], fold_col: str = "fold", folds: int = 5, out: str = "oof",
    calibrate: str | None = None, key: str | None = None, inner_folds: int = 3,
) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by a model that never saw it. One fit runs after the
    other, as plans that carry models are not built in several threads. Scores are written: no plan
    carries several models."""

    def fold(k: int) -> DataFrame:
        train, held = df.filter(F.col(fold_col) != k), df.filter(F.col(fold_col) == k)
        if calibrate:
            return Calibrated(make, key, calibrate, inner_folds).fit(train).score(held, out)
        return session.checkpoint(_scored(make().fit(train), held, out))

    return reduce(lambda a, b: a.unionByName(b), [fold(k) for k in range(folds)])


def together(spark, work: Callable, items) -> list:
    """The results of some work whose jobs overlap, in order. Each runs in a thread with the caller's properties."""
    items = list(items)
    tagged = inheritable_thread_target(spark)(work)
    with ThreadPoolExecutor(max(1, min(PARALLEL_FITS, len(items)))) as pool:
        return list(pool.map(tagged, items))


def leaf_share(rows: DataFrame, weight_col: str = "n") -> float:
    """Least share of the weight in a leaf of a tree: that of MIN_LEAF isolates, as cells are weighted rows."""
    total = rows.agg(F.sum(weight_col)).first()[0] or 0.0
    return min(0.49, MIN_LEAF / total) if total > 0 else 0.0


def labelled_cells(cells: DataFrame, pos: str, n: str) -> DataFrame:
    """Two weighted rows per cell: label 1 with the positive count, label 0 with the rest."""
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col(pos).cast("double").alias("n")),
        F.struct(F.lit(0.0).alias("label"), (F.col(n) - F.col(pos)).cast("double").alias("n")),
    )
    return cells.drop("n").select([c for c in cells.columns if c not in (pos, n, "n")] + [F.inline(both)]).filter(F.col("n") > 0)


def ml_policy(
    train: DataFrame, apply_to: DataFrame, columns: list[str], model_type: str = "logit", calibrate: str | None = None,
    min_prob: float = 0.01, folds: int = 5, seed: int = 42, **params,
) -> DataFrame:
    """P(tested | context) for one drug from (columns, n_pos, n_rows) cells; adds p to ``apply_to`` cells."""
    rows = text_covariates(labelled_cells(train, "n_pos", "n_rows"), columns)
    enc = encoder(columns).fit(rows)
    x = enc.transform(rows).withColumn("__key", F.concat_ws("|", *columns))
    if model_type != "logit":
        params = {"minWeightFractionPerNode": leaf_share(rows)} | params
    make = lambda: build(model_type, "classification", seed, **params)
    target = enc.transform(text_covariates(apply_to, columns))
    if calibrate:
        scored = Calibrated(make, "__key", calibrate, folds, seed).fit(x).score(target, "p")
    else:
        scored = _scored(make().fit(x), target, "p")
    return scored.select(*apply_to.columns, stats.clip_probability(F.col("p"), min_prob, 1 - min_prob).alias("p"))


def effect_learner(cells: DataFrame, columns: list[str], seed: int = 42, **params) -> tuple[DataFrame, dict[str, float]]:
    """Covariate-specific effects by one forest per arm (T-learner).

    ``cells`` has (columns, n1, sy1, n0, sy0). Returns the cells with ``cate`` and the average
    feature importance per covariate.
    """
    text = text_covariates(cells, columns)
    enc = encoder(columns).fit(text)
    x = enc.transform(text)
    importance = {c: 0.0 for c in columns}
    sizes = {c: len(labels) for c, labels in zip(columns, enc.stages[0].labelsArray)}
    for arm in (1, 0):
        rows = x.filter(F.col(f"n{arm}") > 0).withColumns({"label": F.col(f"sy{arm}") / F.col(f"n{arm}"), "n": F.col(f"n{arm}").cast("double")})
        model = build("rf", "regression", seed, **({"minWeightFractionPerNode": leaf_share(rows)} | params)).fit(rows)
        x = model.transform(x).withColumnRenamed("prediction", f"m{arm}")
        at = 0
        weights = model.featureImportances.toArray()
        for c in columns:
            importance[c] += float(weights[at : at + sizes[c]].sum()) / 2
            at += sizes[c]
    return x.withColumn("cate", F.col("m1") - F.col("m0")).select(*cells.columns, "cate"), importance
