"""Cross-fitted main-effects regressions on counted cells, solved from sums.

A cell's features are an intercept and one indicator per covariate level. A weighted least-squares fit
needs the sums of weights per pair of features and of responses per feature, and a fit without a fold
needs the totals less that fold's sums: one aggregate serves all folds, drugs and responses, and no
coefficient passes through the driver. A task solves the systems of one group, whose size is that of
the catalogue and the covariate levels, whatever the number of isolates.

Fitted sums reproduce the observed ones for every covariate level outside the held-out fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERCEPT = "(Intercept)"


def level_features(cell: Column) -> Column:
    """array<string>: the intercept and "position=level" of each covariate of a cell key."""
    levels = F.transform(F.split(cell, r"\|"), lambda v, i: F.concat(i.cast("string"), F.lit("="), v))
    return F.concat(F.array(F.lit(INTERCEPT)), levels)


def predict(cell: Column, beta: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(level_features(cell), zero, lambda acc, f: acc + F.coalesce(F.try_element_at(beta, f), zero))


def _solver(keys: list[str], responses: list[str]):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(rows["f1"].unique())
        at = {f: i for i, f in enumerate(names)}
        folds = sorted(rows["fold"].unique())
        which = {f: i for i, f in enumerate(folds)}
        gram = np.zeros((len(folds), len(names), len(names)))
        is_gram = rows["f2"] != ""
        g, r = rows[is_gram], rows[~is_gram]
        np.add.at(gram, (g["fold"].map(which), g["f1"].map(at), g["f2"].map(at)), g["v"])
        if r.empty:
            return pd.DataFrame(columns=[*keys, *responses, "fold", "names", "values"])
        each = list(r[responses].itertuples(index=False, name=None)) if responses else [()] * len(r)
        number = {x: i for i, x in enumerate(dict.fromkeys(each))}
        column = [number[x] for x in each]
        right = np.zeros((len(folds), len(names), len(number)))
        np.add.at(right, (r["fold"].map(which), r["f1"].map(at), column), r["v"])
        out = []
        key = [rows[k].iloc[0] for k in keys]
        for h, fold in enumerate(folds):
            beta = np.linalg.lstsq(gram.sum(0) - gram[h], right.sum(0) - right[h], rcond=1e-10)[0]
            out += [[*key, *response, fold, names, beta[:, j].tolist()] for response, j in number.items()]
        return pd.DataFrame(out, columns=[*keys, *responses, "fold", "names", "values"])

    return solve


def coefficients(weights: DataFrame, responses: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """(keys, of, fold, beta): main-effects fits that leave the fold out.

    ``weights`` holds (keys, fold, cell, wn) and ``responses`` (keys, of, fold, cell, wy), where wy is the
    weighted sum of the response in the cell.
    """
    one = ["__one"]
    groups = keys or one
    weights, responses = (d.withColumn("__one", F.lit(1)) for d in (weights, responses))
    features = level_features(F.col("cell"))
    left = weights.select(*groups, "fold", "wn", features.alias("fs"), F.explode(features).alias("f1"))
    left = left.select(*groups, "fold", "f1", F.explode("fs").alias("f2"), "wn")
    gram = left.groupBy(*groups, "fold", "f1", "f2").agg(F.sum("wn").cast("double").alias("v"))
    right = responses.select(*groups, *of, "fold", F.explode(features).alias("f1"), "wy").groupBy(*groups, *of, "fold", "f1")
    right = right.agg(F.sum("wy").cast("double").alias("v")).withColumn("f2", F.lit(""))
    rows = right.unionByName(gram, allowMissingColumns=True)
    schema = T.StructType(
        [rows.schema[c] for c in (*groups, *of, "fold")]
        + [T.StructField("names", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    solved = rows.groupBy(*groups).applyInPandas(_solver(groups, of), schema)
    return solved.select(*keys, *of, "fold", F.map_from_arrays("names", "values").alias("beta"))
