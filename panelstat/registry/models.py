"""Model-fit queries. Iterative fits have no SQL form; the driver checks their rows, the tests their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat import session
from panelstat.operators import effects, glm, learners, panel, policy, post
from panelstat.registry.effects import SETTINGS, _flagged, _rounded
from panelstat.sources import warehouse


def policy_ml(spark, sf):
    """Testing probability of every drug in every context from calibrated logistic models."""
    columns = ["ward", "care_type", "year"]
    rows = session.checkpoint(_flagged(spark, sf).select(policy.context_key(columns).alias("context"), "flags"))
    out = policy.logistic_policy(*policy.context_counts(rows, "context"), "context", warehouse.CODES)
    parts = F.split("context", r"\|")
    named = {"ward": parts[0], "care_type": parts[1], "year": parts[2].cast("int"), "p": F.round("p", 6)}
    return out.withColumns(named).select("code", *columns, F.col("n_tested").alias("n_pos"), "n_rows", "p")


def positivity_check(spark, sf):
    df = _flagged(spark, sf).withColumns({"Year": F.col("year"), "Month": F.substring("year_month", 6, 2).cast("int"), "depth": panel.panel_depth()})
    return _rounded(glm.positivity(df.select("Year", "Month", "depth", "flags"), ["Year", "Month", "depth"]))


def logit_testing(spark, sf):
    """Logistic testing model P(tested | ward, care type) of every drug at once."""
    cells = session.checkpoint(effects.selection_cells(*effects.test_counts(_flagged(spark, sf), SETTINGS), []))
    nt = F.col("n1") + F.col("n0")
    cells = cells.withColumns({"features": glm.active_features(F.col("cell"), list(SETTINGS.covariates)), "n": F.col("n_untested") + nt, "pos": nt})
    fit = glm.fit_logit(cells, ["trigger"])
    return _rounded(glm.predict_logit(cells, ["trigger"], fit).select("trigger", "cell", "n", "pos", "p"))


def joint_selection(spark, sf):
    """Joint testing/resistance model of every drug: error correlation and fitted probabilities per cell."""
    cells = session.checkpoint(effects.selection_cells(*effects.test_counts(_flagged(spark, sf), SETTINGS), []))
    out, _ = glm.fit_selection(cells, ["trigger"], list(SETTINGS.covariates))
    return out.withColumns({c: F.round(c, 4) for c in ("p_test", "p_resist_given_tested", "rho")})


def joint_comparison(spark, sf):
    """Effects with saturated testing weights against effects with joint-model weights."""
    df = _flagged(spark, sf)
    standard = effects.estimate_pairs(df, warehouse.CODES, SETTINGS)
    joint = effects.estimate_pairs(df, warehouse.CODES, SETTINGS, joint_selection=True)
    out = post.compare_runs(standard, joint)
    return out.withColumns({c: F.round(c, 4) for c, t in out.dtypes if t == "double"})


def cross_fitted_boosting(spark, sf):
    """Out-of-fold testing probabilities of the drug tested most from calibrated boosted trees."""
    tested, rows = effects.test_counts(_flagged(spark, sf), SETTINGS)
    # the drug tested most, of equals the first by name
    code = tested.groupBy("trigger").agg(F.sum("nt").alias("n")).orderBy(F.desc("n"), "trigger").first()["trigger"]
    own = tested.filter(F.col("trigger") == code).select("cell", "fold", F.col("nt").alias("n_pos"))
    cells = rows.withColumnRenamed("n_all", "n_rows").join(own, ["cell", "fold"], "left").na.fill(0, ["n_pos"])
    parts = F.split("cell", r"\|")
    cells = cells.withColumns({"ward": parts[0], "care_type": parts[1]})
    x = learners.labelled_cells(cells, "n_pos", "n_rows")
    x = learners.encoder(["ward", "care_type"]).fit(x).transform(x)
    x = session.checkpoint(x)
    leaf = learners.leaf_share(x)
    make = lambda: learners.build("xgb", "classification", maxIter=5, maxDepth=3, stepSize=0.2, minWeightFractionPerNode=leaf)
    out = learners.cross_fit(x, make, folds=5, calibrate="sigmoid", key="cell", inner_folds=2)
    return out.groupBy("cell", "fold").agg(F.round(F.avg("oof"), 6).alias("p_oof"), F.sum("n").alias("n"))


def effect_heterogeneity(spark, sf):
    """Covariate-specific effects of the strongest pair from one forest per arm."""
    cells, _, _ = effects.estimation_cells(_flagged(spark, sf), warehouse.CODES, SETTINGS, [])
    cells = session.checkpoint(cells)
    found = effects.apply_gates(effects.targeted_estimates(cells, []), SETTINGS)
    strongest = post.strongest_pair(found.filter("status = 'ok'")).select("trigger", "target")
    cells = cells.join(session.small_side(strongest), ["trigger", "target"], "left_semi")
    parts = F.split("cell", r"\|")
    per_cell = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n1", "sy1", "n0", "sy0")]).withColumns({"ward": parts[0], "care_type": parts[1]})
    out, _ = learners.effect_learner(session.checkpoint(per_cell), ["ward", "care_type"])
    return out.select("ward", "care_type", "n1", "n0", F.round("cate", 6).alias("cate"))


QUERIES = {
    "policy_ml": (policy_ml, None),
    "positivity_check": (positivity_check, None),
    "logit_testing": (logit_testing, None),
    "joint_selection": (joint_selection, None),
    "joint_comparison": (joint_comparison, None),
    "cross_fitted_boosting": (cross_fitted_boosting, None),
    "effect_heterogeneity": (effect_heterogeneity, None),
}
