import json
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstat import session
from panelstat.functions import stats
from panelstat.operators import coverage, drugdims, effects, glm, pairs, panel, post, profile, quantiles, recode, rules, splits
from panelstat.plans import analysis, explore, ingest
from panelstat.sources import arrow_source, readers, warehouse, writers


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="panelstat-test-")


# ---- rules ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", "2019", True), (2, None, "x", False), (3, "nan", None, None), (4, "ba", "2024", True), (5, "", "2020", False)]
    return spark.createDataFrame(rows, "id int, t string, y string, b boolean")


@pytest.mark.parametrize(
    "rule, ids",
    [
        (rules.Rule("t", "not_equals", "a"), [2, 3, 4, 5]),
        (rules.Rule("t", "not_in", values=("a", "nan")), [4, 5]),
        (rules.Rule("t", "in", values=("nan",)), [2, 3]),
        (rules.Rule("t", "regex", "a"), [1]),
        (rules.Rule("t", "contains", "a"), [1, 2, 3, 4]),
        (rules.Rule("y", "gte", "2020"), [4, 5]),
        (rules.Rule("y", "gte", "x"), [2]),
        (rules.Rule("y", "range", min=2019, max=2020), [1, 5]),
        (rules.Rule("b", "is_true"), [1, 4]),
        (rules.Rule("b", "is_false"), [2, 5]),
        (rules.Rule("b", "equals", "True"), [1, 4]),
        (rules.Rule("y", "is_null"), [3]),
        (rules.Rule("t", "in", values=()), []),
    ],
)
def test_rule_semantics(people, rule, ids):
    assert sorted(r.id for r in rules.apply(people, [rule]).collect()) == ids
    assert people.filter(rules.flag(rule, people)).count() == len(ids)


def test_rules_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = rules.apply(df, [rules.Rule("o_orderstatus", "in", values=("P", "F")), rules.Rule("o_orderkey", "range", min=5, max=50)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus" in text and "GreaterThanOrEqual(o_orderkey,5)" in text


def test_report_stops_on_empty(people):
    out = rules.report(people, [rules.Rule("t", "equals", "none such"), rules.Rule("y", "not_null")]).collect()
    assert [(r.step, r.n_before, r.n_after) for r in out] == [(1, 5, 0)]


def test_unknown_inputs(people):
    with pytest.raises(ValueError):
        rules.Rule.from_dict({"column": "t", "operator": "like"})
    with pytest.raises(ValueError):
        rules.apply(people, [rules.Rule("zz", "equals", 1)])
    with pytest.raises(ValueError):
        rules.cohort(people, filters={"zz": 1})


def test_ruleset_round_trip(scratch):
    path = os.path.join(scratch, "r.json")
    rs = rules.cohort_rules()["escherichia"]
    rs.to_json(path)
    assert rules.RuleSet.from_json(path) == rs
    assert len(rules.cohort_rules()) == 7 and len(rules.cohort_rules()["all"].rules) == 3
    assert rules.display_name("klebsiella") == "Klebsiella pneumoniae"


# ---- panels and screens --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def flagged(spark, sf):
    return panel.with_flags(warehouse.isolates(spark, sf), drop_i=True).persist()


def brute_tables(rows):
    out = {}
    for flags in rows:
        got = {f["code"]: f["r"] for f in flags}
        for a, r in got.items():
            for d in warehouse.CODES:
                if a != d:
                    t = out.setdefault((a, d), [0, 0, 0, 0])
                    t[(0 if r else 2) + (0 if d in got else 1)] += 1
    return out


def test_pair_tables_brute_force(flagged):
    want = brute_tables([r.flags for r in flagged.select("flags").collect()])
    got = {(r.trigger, r.target): [r.a, r.b, r.c, r.d] for r in pairs.pair_tables(flagged, codes=warehouse.CODES).collect()}
    assert got == want


def test_resistant_implies_tested(flagged):
    t = pairs.pair_tables(flagged)
    assert t.filter((F.col("a") + F.col("b") != F.col("n_A_R")) | (F.col("b") < 0) | (F.col("d") < 0)).count() == 0


def test_q_values_monotone(spark):
    ps = [0.001, 0.04, 0.04, 0.2, 0.9]
    df = spark.createDataFrame([("t", str(i), p) for i, p in enumerate(ps)], "trigger string, target string, p_value double")
    got = [(r.p_value, r.q_value) for r in pairs.benjamini_hochberg(df).orderBy("p_value").collect()]
    want, low = [], 1.0
    for i in range(len(ps) - 1, -1, -1):
        low = min(low, ps[i] * len(ps) / (i + 1))
        want.append((ps[i], low))
    assert [q for _, q in got] == pytest.approx([q for _, q in want[::-1]])


def test_screen_gates(flagged):
    assert pairs.screen(flagged, min_group=10**6).count() == 0
    two = pairs.screen(flagged, min_group=5, min_trigger_tested=5, crude_threshold=1.0, candidate_triggers=["Brand#1"], candidate_targets=["Brand#2", "Brand#1"])
    assert [(r.trigger, r.target) for r in two.collect()] == [("Brand#1", "Brand#2")]


def test_wide_round_trip(spark, sf):
    p = warehouse.panels(spark, sf)
    drugs = {c.upper(): warehouse.drug_column(c) for c in warehouse.CODES}
    upper = p.withColumn("tests", F.transform("tests", lambda t: F.struct(F.upper(t["code"]).alias("code"), t["outcome"].alias("outcome"))))
    wide = panel.panel_to_pairs(upper, drugs, ["isolate_id"])
    assert panel.paired_drugs(wide.columns) == drugs
    again = panel.panel_from_pairs(wide, drugs, ["isolate_id"])
    key = lambda df: df.select("isolate_id", F.array_sort("tests").alias("t"))
    assert key(again).exceptAll(key(upper)).count() == 0


def test_column_detection():
    cols = ["AMK - Amikacin_Tested", "AMK - Amikacin_Outcome", "5FC - Fluor_Tested", "5FC - Fluor_Outcome", "X_Tested", "CIP - Cipro", "C-CARB - sonstige Carbapenemase nachgewiesen"]
    assert panel.paired_drugs(cols) == {"AMK": "AMK - Amikacin", "5FC": "5FC - Fluor"}
    assert list(panel.strict_drugs(cols)) == ["AMK"]
    assert panel.raw_drug_columns(cols) == ["CIP - Cipro"]


# ---- splits and effects --------------------------------------------------------------------------


def test_splits(spark, sf):
    df = warehouse.meta(spark, sf).select("isolate_id", "lab")
    out = splits.with_fold(splits.group_split(df, "lab", 0.3), "isolate_id", 5)
    assert out.select("lab", "is_test").distinct().count() == 25
    assert out.filter("is_test").select("lab").distinct().count() == 8
    counts = {r.fold: r["count"] for r in out.groupBy("fold").count().collect()}
    assert sorted(counts) == [0, 1, 2, 3, 4] and max(counts.values()) < 1.2 * min(counts.values())
    share = splits.row_split(df, "isolate_id", 0.3).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.25 < share < 0.35


def row_level_estimate(a, y, w, q1, q0, g1):
    h = a / g1 - (1 - a) / (1 - g1)
    q = np.where(a == 1, q1, q0)
    eps = np.sum(w * h * (y - q)) / np.sum(w * h * h)
    s1, s0 = q1 + eps / g1, q0 - eps / (1 - g1)
    psi = np.average(s1 - s0, weights=w)
    ic = w / w.mean() * (h * (y - np.where(a == 1, s1, s0)) + s1 - s0 - psi)
    return psi, np.sqrt(np.var(ic, ddof=1) / len(a)), eps


def test_cells_equal_rows(spark):
    rng = np.random.default_rng(7)
    n = 4000
    cell = rng.integers(0, 12, n)
    a = rng.integers(0, 2, n)
    y = np.where(rng.random(n) < 0.3, rng.choice([1.5, 2.0, 7.0], n), 0.0)
    w, g1 = 1 + cell * 0.1, 0.2 + cell * 0.05
    q1, q0 = 0.5 + cell * 0.02, 0.4 + cell * 0.01
    rows = [("A", "D", int(c), int(x), float(v), float(ww), float(g), float(p), float(q)) for c, x, v, ww, g, p, q in zip(cell, a, y, w, g1, q1, q0)]
    df = spark.createDataFrame(rows, "trigger string, target string, cell int, a int, y double, w double, g1 double, q1 double, q0 double")
    aggs = [F.count_if(F.col("a") == k).alias(f"n{k}") for k in (1, 0)]
    for k in (1, 0):
        pick = F.when(F.col("a") == k, F.col("y")).otherwise(0.0)
        aggs += [F.sum(pick).alias(f"sy{k}"), F.sum(pick * pick).alias(f"syy{k}")]
    got = effects.targeted_estimates(df.groupBy("trigger", "target", "cell", "w", "g1", "q1", "q0").agg(*aggs), []).first()
    psi, se, eps = row_level_estimate(a, y, w, q1, q0, g1)
    assert (got.rd, got.se, got.epsilon) == pytest.approx((psi, se, eps), rel=1e-9)
    assert got.n_used == n


def test_pair_subset_equals_full(flagged):
    s = effects.EffectSettings(covariates=("ward",), context=("year",), min_cell_n=5, min_tested=20, min_group=5, nuisance="saturated")
    some = [("Brand#1", "Brand#2"), ("Brand#3", "Brand#9")]
    full = effects.estimate_pairs(flagged, warehouse.CODES, s)
    part = effects.estimate_pairs(flagged, warehouse.CODES, s, pairs=some)
    key = lambda df: {(r.trigger, r.target): (r.status, r.rd, r.se) for r in df.collect()}
    everything = key(full)
    got = key(part)
    assert set(got) == set(some)
    for p in some:
        assert got[p] == pytest.approx(everything[p]) if got[p][1] is not None else got[p] == everything[p]


def test_no_self_fold_leakage(flagged):
    """Changing one fold's outcomes must not move that fold's own out-of-fold means."""
    s = effects.EffectSettings(covariates=("ward",), context=("year",), min_cell_n=1, nuisance="saturated")
    tested, rows = effects.test_counts(flagged, s)
    swapped = {a: F.when(F.col("fold") == 2, F.col(b)).otherwise(F.col(a)) for a, b in (("n1", "n0"), ("n0", "n1"))}
    flipped = tested.withColumns(swapped)
    g = lambda t: {(r.trigger, r.cell): r.g1 for r in effects.trigger_cells(t, rows, [], s).filter("fold = 2").collect()}
    assert g(tested) == pytest.approx(g(flipped))


def test_trees_keep_leaves_of_few_isolates_together(spark):
    from panelstat.operators import learners

    schema = "ward string, n1 long, sy1 double, n0 long, sy0 double"
    few = [("a", 5, 5.0, 5, 0.0), ("b", 100, 20.0, 100, 20.0)]
    many = [("a", 100, 100.0, 100, 0.0), few[1]]
    spread = []
    for rows in (few, many):
        out, _ = learners.effect_learner(spark.createDataFrame(rows, schema), ["ward"], numTrees=5, maxDepth=2)
        got = {r.ward: r.cate for r in out.collect()}
        spread.append(abs(got["a"] - got["b"]))
    assert spread[0] < 1e-9 and spread[1] > 0.3
    assert learners.leaf_share(spark.createDataFrame([(80.0,), (120.0,)], "n double")) == learners.MIN_LEAF / 200
    assert learners.leaf_share(spark.createDataFrame([], "n double")) == 0.0


def test_positivity_counts_each_combination_and_fits_to_its_score_equations(spark):
    rng = np.random.default_rng(11)
    codes = ["A", "B", "C"]
    rows = []
    for i in range(400):
        n, u = (None if i % 50 == 0 else int(rng.integers(0, 3))), float(rng.integers(0, 4)) / 2
        flags = [(c,) for c, base in zip(codes, (0.9, 0.4, 0.02)) if rng.random() < base]
        rows.append((n, u, None if i % 40 == 7 else flags + [(None,)] * (i % 9 == 0)))
    df = spark.createDataFrame(rows, "n int, u double, flags array<struct<code:string>>")
    cells = glm.testing_cells(df, ["n", "u"])
    wanted = {}
    for n, u, flags in rows:
        for c in codes:
            k = wanted.setdefault((c, float(n or 0), u), [0, 0])
            k[0] += 1
            k[1] += (c,) in (flags or [])
    names = [glm.INTERCEPT, "n", "u"]
    got = cells.collect()
    assert all([t.f for t in r.features] == names for r in got)
    assert {(r.code, r.features[1].x, r.features[2].x): [r.n, r.pos] for r in got} == wanted and len(got) == len(wanted)
    fit = glm.fit_logit(cells, ["code"])
    assert fit.converged
    fitted = glm.predict_logit(cells, ["code"], fit).collect()
    for c in codes:
        for k, name in enumerate(names):
            score = sum((r.pos - r.n * r.p) * r.features[k].x for r in fitted if r.code == c)
            ridge = 0.0 if k == 0 else fit.coefficients[(c,)][name]
            assert abs(score - ridge) < 1e-3
    found = {r.code: r for r in glm.positivity(df, ["n", "u"], min_prob=0.1).collect()}
    assert {c: r.too_small for c, r in found.items()} == {"A": False, "B": False, "C": True}
    assert glm.positivity(df.limit(0), ["n", "u"]).count() == 0
    least = min(r.p for r in fitted if r.code == "B" and r.pos)
    assert found["B"].n_rows == 400 and abs(found["B"].min_p_tested - least) < 1e-9


def test_logit_against_numpy(spark):
    rng = np.random.default_rng(3)
    levels = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    rows = [("D", "|".join(v), 200, int(rng.integers(20, 150))) for v in levels]
    cells = spark.createDataFrame(rows, "code string, cell string, n long, pos long").withColumn("features", glm.active_features(F.col("cell"), ["u", "v"]))
    fit = glm.fit_logit(cells, ["code"], ridge=1.0)
    assert fit.converged
    names = ["(Intercept)", "u=a", "u=b", "v=x", "v=y"]
    x = np.array([[1, v[0] == "a", v[0] == "b", v[1] == "x", v[1] == "y"] for v in levels], float)
    n, pos = np.full(4, 200.0), np.array([r[3] for r in rows], float)
    b = np.zeros(5)
    pen = np.diag([0, 1, 1, 1, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + pen + 1e-9 * np.eye(5), x.T @ (pos - n * p) - pen @ b)
    got = fit.coefficients[("D",)]
    assert [got[k] for k in names] == pytest.approx(b.tolist(), abs=1e-5)


def test_bivariate_normal(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.5), (1.0, -1.0, 0.0), (0.3, 0.8, -0.7), (0.0, 0.0, -0.9)], "h double, k double, r double")
    got = [r[0] for r in df.select(glm.bivariate_normal_cdf(F.col("h"), F.col("k"), F.col("r"))).collect()]
    assert got[0] == pytest.approx(0.25 + np.arcsin(0.5) / (2 * np.pi), abs=1e-9)
    assert got[1] == pytest.approx(0.8413447460685429 * 0.15865525393145707, abs=1e-9)
    assert got[3] == pytest.approx(0.25 + np.arcsin(-0.9) / (2 * np.pi), abs=1e-6)
    rng = np.random.default_rng(1)
    z = rng.standard_normal((2_000_000, 2))
    second = -0.7 * z[:, 0] + np.sqrt(1 - 0.49) * z[:, 1]
    assert got[2] == pytest.approx(np.mean((z[:, 0] < 0.3) & (second < 0.8)), abs=2e-3)


def test_selection_model_recovers_rates(spark):
    """Intercept-only groups: fitted probabilities equal the observed shares."""
    rows = [("A", "u", 600, 100, 300), ("B", "u", 200, 300, 100)]
    cells = spark.createDataFrame(rows, "trigger string, cell string, n_untested long, n1 long, n0 long")
    out, _ = glm.fit_selection(cells, ["trigger"], ["c"])
    got = {r.trigger: (r.p_test, r.p_resist_given_tested) for r in out.collect()}
    assert got["A"] == pytest.approx((0.4, 0.25), abs=5e-3)
    assert got["B"] == pytest.approx((2 / 3, 0.75), abs=5e-3)


def test_selection_falls_back_group_by_group(spark):
    """A group that cannot settle in the given iterations takes separate models; the other keeps its own fit."""
    rows = [("A", "u", 600, 100, 300), ("B", "u", 1, 99_999, 0), ("B", "v", 99_999, 0, 1)]
    cells = spark.createDataFrame(rows, "trigger string, cell string, n_untested long, n1 long, n0 long")
    out, fit = glm.fit_selection(cells, ["trigger"], ["c"], max_iter=20)
    assert ("A",) not in fit.unsettled
    got = {(r.trigger, r.cell): r for r in out.collect()}
    assert len(got) == 3 and got[("A", "u")].joint
    assert all(not got[("B", c)].joint and got[("B", c)].rho == 0.0 for c in "uv")
    assert got[("B", "u")].p_test > 0.95 and got[("B", "v")].p_test < 0.05


# ---- post-estimation ------------------------------------------------------------------------------


def test_shrinkage_properties(spark):
    rows = [("a", "b", 0.1, 0.05, "ok"), ("a", "c", -0.02, 0.01, "ok"), ("b", "c", 0.4, 0.2, "ok"), ("c", "a", 1.0, 0.0, "ok"), ("c", "b", 9.0, 1.0, "failed")]
    df = spark.createDataFrame(rows, "trigger string, target string, rd double, se double, status string")
    for prior in post.PRIORS:
        out = post.shrink(df, prior=prior).collect()
        assert len(out) == 3
        for r in out:
            assert abs(r.theta_shrunken) < abs(r.rd) and (r.prob_positive > 0.5) == (r.rd > 0)
    with pytest.raises(ValueError):
        post.shrink(df, prior="flat")


def test_export_files(spark, scratch):
    rows = [("a", "b", 0.1, 0.01, 0.001, 100.0, "ok"), ("c", "b", 0.2, 0.01, 0.001, 100.0, "ok"), ("a", "c", -0.1, 0.01, 0.3, 10.0, "failed")]
    df = spark.createDataFrame(rows, "trigger string, target string, rd double, se double, p_value double, ess double, status string")
    paths = post.export_results(df, scratch, p_threshold=0.05)
    deps = spark.read.json(paths["dependencies"]).collect()
    assert [(r.target, r.triggers) for r in deps] == [("b", ["a", "c"])]
    out = writers.save_results(df, f"{scratch}/res", {"k": 1})
    back, manifest = writers.load_results(spark, f"{scratch}/res")
    assert back.count() == 3 and manifest["config"] == {"k": 1} and os.path.exists(out["manifest"])


def test_single_arm_gives_null(spark):
    df = spark.createDataFrame([("a", "b", 30, 0, 5.0, 0.0, 9.0, 0.0, 1.0, 0.5, 0.2, 0.0)], "trigger string, target string, n1 long, n0 long, sy1 double, sy0 double, syy1 double, syy0 double, w double, g1 double, q1 double, q0 double")
    r = effects.apply_gates(effects.targeted_estimates(df, []), effects.EffectSettings(min_tested=1)).first()
    assert r.status == "failed" and r.rd is None and r.skip_reason.startswith("arms: 30 and 0")


def _own_tables(spark, tmp_path):
    """Orders with three lines each, of two brands, from two laboratories."""
    ts = "timestamp'2020-01-02'"
    tables = {
        "orders": f"select id as o_orderkey, id % 10 as o_custkey, 'O' as o_orderstatus, {ts} as o_orderdate, '1-URGENT' as o_orderpriority from range(60)",
        "customer": "select id as c_custkey, cast(id % 2 as int) as c_nationkey, 10.0D as c_acctbal, 'AUTO' as c_mktsegment from range(10)",
        "nation": "select cast(id as int) as n_nationkey, concat('N', id) as n_name, 0 as n_regionkey from range(2)",
        "region": "select 0 as r_regionkey, 'R' as r_name",
        "part": "select id as p_partkey, concat('Brand#', id + 1) as p_brand from range(2)",
        "lineitem": "select id div 3 as l_orderkey, id % 2 as l_partkey, cast(id % 3 + 1 as int) as l_linenumber, 'R' as l_returnflag from range(180)",
    }
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_tested_panels_are_built_once(spark, tmp_path):
    from panelstat.registry import rules as queries

    own = _own_tables(spark, tmp_path)
    df = queries.low_coverage_panels(spark, own)
    assert not [f for f in df.inputFiles() if "lineitem" in f]
    assert {r.code for r in df.collect()} == {"BRAND#1", "BRAND#2"}


def test_discovery_isolates_are_built_once(spark, tmp_path):
    from panelstat.registry import effects as queries

    df = queries._discovery(spark, _own_tables(spark, tmp_path))
    assert not [f for f in df.inputFiles() if "lineitem" in f]
    assert df.count() == 60 and df.select("lab", "is_estimation").distinct().count() == 2


# ---- drug lists -----------------------------------------------------------------------------------


def test_drug_matching(spark):
    drugs = spark.createDataFrame([("Amoxicillin/clavulanic acid", "Penicillin (β-lactam)"), ("bactrim", "Sulfonamide"), ("Ciprofloxacine", "Quinolone"), ("Zzz", None)], "`Antibiotic Name` string, Class string")
    ref = spark.createDataFrame([("Amoxicillin/Clavulanic-acid", "Access"), ("Sulfamethoxazole/trimethoprim", "Access"), ("Ciprofloxacin", "Watch"), ("Norfloxacin", "Watch")], "Antibiotic string, Category string")
    syn = spark.createDataFrame([("bactrim", "sulfamethoxazole/trimethoprim")], "alias string, name string")
    rows = {r["Antibiotic Name"]: r for r in drugdims.match_drugs(drugs, ref, syn, ref_columns=["Category"]).collect()}
    assert rows["bactrim"]["WHO_Match"] == "Sulfamethoxazole/trimethoprim"
    assert rows["Amoxicillin/clavulanic acid"]["Match_Type"] == "PERFECT" and rows["Amoxicillin/clavulanic acid"]["Broad Class"] == "β-lactam"
    assert rows["Ciprofloxacine"]["Match_Type"] == "FUZZY(0.96)" and rows["Ciprofloxacine"]["Category"] == "Watch"
    assert rows["Zzz"]["WHO_Match"] == "NO MATCH" and rows["Zzz"]["Category"] == "Not Set" and rows["Zzz"]["Broad Class"] == "Not Set"


def test_fuzzy_paths_agree(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("norm")).distinct()
    ref = drugdims.reference_names(spark.createDataFrame([("small rings",), ("red wdget",), ("blue bolts",)], "n string"), "n")
    key = lambda df: sorted((r.norm, r.fuzzy_name, round(r.fuzzy_score, 9)) for r in df.collect())
    closure = key(drugdims.fuzzy_matches(names, ref))
    assert closure and closure == key(drugdims.fuzzy_matches(names, ref, max_closure=0))


def test_fuzzy_matcher_sees_each_name_once(spark, tmp_path, monkeypatch):
    seen = str(tmp_path)

    def counted(names):
        @F.pandas_udf("name string, score double")
        def best(norm: pd.Series) -> pd.DataFrame:
            with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
                f.write("".join(x + "\n" for x in norm))
            return pd.DataFrame([(names[0][1], 0.9)] * len(norm), columns=["name", "score"])

        return best

    monkeypatch.setattr(drugdims, "_best_in", counted)
    drugs = spark.range(600).select(F.concat(F.lit("smal wid get"), (F.col("id") % 3).cast("string")).alias("Antibiotic Name"))
    ref = spark.createDataFrame([("small widget", "Access")], "Antibiotic string, Category string")
    syn = spark.createDataFrame([], "alias string, name string")
    out = drugdims.match_drugs(drugs, ref, syn, ref_columns=["Category"]).collect()
    assert len(out) == 600 and {r.WHO_Match for r in out} == {"small widget"}
    rows = [x for f in os.listdir(seen) for x in open(os.path.join(seen, f)).read().split()]
    assert len(rows) <= 12 and set(rows) == {"smalwidget0", "smalwidget1", "smalwidget2"}


def test_similar_pairs_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(4)
    made = {"", "a", "aa", "é😀x", "é😀y"} | {"".join(rng.choice(list("aaabcdeé😀"), rng.integers(1, 14))) for _ in range(160)}
    made = sorted(made)
    left, right = made[::2] + ["é😀x", ""], made[1::2] + ["a", ""]
    names = spark.createDataFrame([(x,) for x in left], "norm string").distinct()
    ref = spark.createDataFrame([(x, x, i) for i, x in enumerate(sorted(set(right)))], "rnorm string, ref_name string, ref_order int")
    for t in (0.6, 0.8, 1.0):
        got = [(r.norm, r.rnorm, r.score) for r in drugdims.similar_pairs(names, ref, t).collect()]
        expected = {(a, b, SequenceMatcher(None, a, b).ratio()) for a in set(left) for b in set(right)}
        assert sorted(got) == sorted(e for e in expected if e[2] >= t)


def test_class_lookup(spark):
    dim = spark.createDataFrame([("A - a", "X"), ("B - b", "X"), ("C - c", "Y")], "`Full Name` string, Class string")
    assert sorted(r["name"] for r in drugdims.drugs_of(dim, "Class", "X").collect()) == ["A - a", "B - b"]
    with pytest.raises(ValueError):
        drugdims.drugs_of(dim, "Class", ["X", "Q"])
    assert drugdims.drugs_of(dim, "Class", ["Q"], strict=False).count() == 0


# ---- sources --------------------------------------------------------------------------------------


def test_mixed_formats(spark, scratch):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"id": [1, 2], "x": [0.5, None]}), f"{scratch}/a.feather")
    feather.write_feather(pa.table({"id": [3], "z": ["q"]}), f"{scratch}/b.feather")
    pd.DataFrame({"id": [4], "Unnamed: 0": [9]}).to_csv(f"{scratch}/c.csv", index=False)
    pd.DataFrame({"id": [5], "y": [True]}).to_json(f"{scratch}/d.json", orient="records", lines=True)
    pd.DataFrame({"id": [6]}).to_parquet(f"{scratch}/e.parquet")
    text = readers.read_any(spark, f"{scratch}/a.feather")
    assert sorted(map(tuple, text.select("id", "x").collect())) == [("1", "0.5"), ("2", None)]
    spark.dataSource.register(arrow_source.ArrowFilesSource)
    both = spark.read.format("arrow_files").load(scratch)
    assert both.count() == 3 and set(both.columns) == {"id", "x", "z"}
    loader = readers.MixedLoader(spark)
    df = loader.load([scratch], extensions=[".csv", ".json", ".parquet"])
    assert sorted(r.id for r in df.collect()) == [4, 5, 6]
    assert "Unnamed: 0" not in df.columns and df.filter(F.col("__source__").isNull()).count() == 0
    loader.register_reader("xyz", lambda s, paths: s.createDataFrame([(7,)], "id long"))
    assert loader.load([f"{scratch}/f.xyz"]).first().id == 7
    with pytest.raises(ValueError):
        loader.load([f"{scratch}/g.abc"])


def test_corrupt_files(spark, scratch):
    spark.range(3).write.parquet(f"{scratch}/ok.parquet")
    with open(f"{scratch}/bad.parquet", "w") as f:
        f.write("not parquet")
    files = [f"{scratch}/ok.parquet", f"{scratch}/bad.parquet"]
    schema_free = readers.MixedLoader(spark).load(files, add_source=False)
    assert schema_free.count() == 3
    with pytest.raises(Exception):
        readers.MixedLoader(spark, fail_fast=True).load(files, add_source=False).count()


def test_csv_codes_stay_text(spark, scratch):
    with open(f"{scratch}/k.csv", "w") as f:
        f.write("KreisZiffer,plz,n,v\n12,01234,5,1.5\n13,99999,6,2.5\n")
    df = readers.read_csv_safely(spark, f"{scratch}/k.csv")
    assert dict(df.dtypes) == {"KreisZiffer": "string", "plz": "string", "n": "int", "v": "double"}


def test_save_dataset(spark, sf, scratch):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    out = writers.save_dataset(df, scratch, "my orders", partition_on=["o_orderstatus"], rows_per_file=100)
    assert spark.read.parquet(out).count() == df.count()
    meta = json.load(open(f"{out}/_dataset.json"))
    assert meta["rows"] == df.count() and meta["partition_on"] == ["o_orderstatus"]
    with pytest.raises(ValueError):
        writers.save_dataset(df, scratch, "x", fmt="feather")


def test_duplicate_columns(spark):
    with pytest.raises(ValueError):
        readers.require_unique_columns(spark.createDataFrame([(1, 2)], "a int, b int").select("a", F.col("b").alias("a")))


# ---- flows ----------------------------------------------------------------------------------------


def test_ingest_explore_flow(spark, sf, scratch):
    result = ingest.structure_export(warehouse.raw_export(spark, sf), min_ratio=0.01)
    assert len(result.drugs) == 25
    paths = ingest.write_structured(result, scratch)
    assert all(os.path.exists(paths[x]) for x in ("without_age", "under_one", "affected_by_test", "affected_by_outcome", "coverage_by_test"))
    df, drugs = ingest.load_structured(spark.read.parquet(paths["wide"]))
    assert len(drugs) == 25 and "Early Rehabilitation" not in {r[0] for r in df.select("ARS_WardType").distinct().collect()}
    definition = rules.RuleSet((rules.Rule("CareType", "in", values=("In-Patient", "Out-Patient")),))
    tables = explore.profile_cohort(df, definition, years=(1995, 2001))
    explore.write_profile(tables, f"{scratch}/profile")
    attrition = tables["attrition"].orderBy("step").collect()
    assert attrition[-1].n_after == tables["cohort"].count() > 0
    keyed = explore.profile_cohorts(df, {"all": rules.RuleSet()})
    assert keyed["prevalence"].count() >= 0


def test_analysis_flow(spark, sf, scratch):
    df = warehouse.isolates(spark, sf)
    s = effects.EffectSettings(covariates=("ward",), context=("year",), min_cell_n=5, min_tested=20, min_group=5)
    got = analysis.run(df, warehouse.CODES, s, top_n=3)
    chosen = {(r.trigger, r.target) for r in got.screen.collect()}
    assert 0 < len(chosen) <= 3
    assert {(r.trigger, r.target) for r in got.results.collect()} == chosen
    flagged = panel.with_flags(df, drop_i=True)
    results = effects.estimate_pairs(flagged, warehouse.CODES, s, pairs=[("Brand#1", "Brand#2"), ("Brand#2", "Brand#1")])
    screen = results.select("trigger", "target", F.lit(1.5).alias("or_unadjusted"), F.lit(0.01).alias("q_value"))
    out = analysis.write(analysis.Analysis(screen, results, []), scratch, s)
    assert os.path.exists(out["manifest"]) and spark.read.option("header", "true").csv(out["results"]).count() == 2
    assert spark.read.option("header", "true").csv(out["screen_vs_effect"]).count() == results.filter("status = 'ok'").count()


def test_cohorts_years_and_testing_models(spark, sf, scratch):
    df = warehouse.isolates(spark, sf)
    s = effects.EffectSettings(covariates=("ward",), context=("year",), min_tested=20, min_group=5)
    cohorts = {"all": rules.RuleSet(), "again": rules.RuleSet()}
    table = analysis.compare_testing_models(df, warehouse.CODES, cohorts, f"{scratch}/compare", settings=s, top_n=1)
    rows = table.collect()
    assert {r.cohort for r in rows} == {"all", "again"} and all(np.isfinite(r.rd_diff) for r in rows)
    found = analysis.run(df, warehouse.CODES, s, top_n=1)
    yearly = analysis.reestimate_by_year(df, found, warehouse.CODES, s, "year")
    assert yearly.count() == df.select("year").distinct().count() or yearly.count() > 0


def test_chosen_pairs_without_tests_are_failed_rows(spark, sf):
    s = effects.EffectSettings(covariates=("ward",), context=("year",), min_cell_n=5, min_tested=20, min_group=5)
    flagged = panel.with_flags(warehouse.isolates(spark, sf), drop_i=True)
    asked = [("Brand#1", "Brand#2"), ("Brand#1", "Unknown"), ("Unknown", "Brand#2")]
    rows = {(r.trigger, r.target): r for r in effects.estimate_pairs(flagged, warehouse.CODES, s, pairs=asked).collect()}
    assert set(rows) == set(asked)
    assert rows[("Brand#1", "Brand#2")].status == "ok"
    for pair, word in ((("Brand#1", "Unknown"), "target"), (("Unknown", "Brand#2"), "trigger")):
        assert rows[pair].status == "failed" and word in rows[pair].skip_reason and rows[pair].rd is None
    keyed = effects.estimate_pairs(flagged.withColumn("half", F.col("isolate_id") % 2), warehouse.CODES, s, ["half"], asked)
    assert keyed.count() == 6


def test_many_pairs_equal_few(spark, sf):
    s = effects.EffectSettings(covariates=("ward",), context=("year",), min_cell_n=5, min_tested=20, min_group=5)
    flagged = panel.with_flags(warehouse.isolates(spark, sf), drop_i=True)
    few = [("Brand#1", "Brand#2"), ("Brand#2", "Brand#1")]
    many = few + [(f"x{i}", f"y{i}") for i in range(6_000)]
    got = [effects.bounded_effects(flagged, warehouse.CODES, s, pairs=p) for p in (few, many)]
    first, second = (sorted((r.trigger, r.target, round(r.rd, 9)) for r in g.collect()) for g in got)
    assert first == second and len(first) == 2


def test_results_per_cohort(spark):
    rows = [("x", "a", "b", 0.2), ("x", "c", "b", 0.1), ("y", "a", "b", -0.3)]
    df = spark.createDataFrame(rows, "cohort string, trigger string, target string, rd double")
    maps = {(r.cohort, r.target): dict(r.effects) for r in post.effect_map(df, ["cohort"]).collect()}
    assert maps == {("x", "b"): {"a": 0.2, "c": 0.1}, ("y", "b"): {"a": -0.3}}
    deps = {(r.cohort, r.target): r.triggers for r in post.dependencies(df, keys=["cohort"]).collect()}
    assert deps == {("x", "b"): ["a", "c"], ("y", "b"): ["a"]}
    assert {r.cohort: r.n_pairs for r in post.summary_statistics(df, ["cohort"]).collect()} == {"x": 2, "y": 1}
    tied = df.withColumn("rd", F.lit(0.5)).withColumn("status", F.lit("ok"))
    assert post.strongest_pair(tied).first().trigger == "a"


def test_empty_input_leaves_the_stored_dataset(spark, scratch):
    df = spark.range(3)
    path = writers.save_dataset(df, scratch, "kept")
    with pytest.raises(ValueError):
        writers.save_dataset(df.limit(0), scratch, "kept")
    assert spark.read.parquet(path).count() == 3


def test_csv_files_are_united_by_name(spark, scratch):
    os.makedirs(f"{scratch}/mixed")
    for name, text in {"a.csv": "id,drug,lab\n1,x,L1\n", "b.csv": "lab,id\nL9,7\n", "c.csv": "id,drug,lab\n2,y,L2\n"}.items():
        with open(f"{scratch}/mixed/{name}", "w") as f:
            f.write(text)
    for loader in (readers.MixedLoader(spark), readers.MixedLoader(spark, schema="lab string, id int, drug string")):
        got = {(r.id, r.drug, r.lab) for r in loader.load([f"{scratch}/mixed"], [".csv"]).collect()}
        assert got == {(1, "x", "L1"), (2, "y", "L2"), (7, None, "L9")}


def test_affected_rows_by_outcome(spark):
    cov = spark.createDataFrame([("A", "Dropped"), ("B", "Kept")], "code string, status string")
    tests = [(1, [("A", None)]), (2, [("A", "R"), ("B", "S")]), (3, [("B", "S")])]
    df = spark.createDataFrame(tests, "id int, tests array<struct<code:string,outcome:string>>")
    assert {r.id for r in coverage.affected_rows(df, cov).collect()} == {1, 2}
    assert {r.id for r in coverage.affected_rows(df, cov, by_outcome=True).collect()} == {2}
    assert {r.id: len(r.tests) for r in coverage.drop_low_coverage(df, cov).collect()} == {1: 0, 2: 1, 3: 1}


def test_lookup_of_any_size(spark):
    df = spark.createDataFrame([("k7",), ("z",), (None,)], "k string")
    big = {f"k{i}": f"v{i}" for i in range(2_000)}
    assert [r[0] for r in df.select(recode.lookup(F.col("k"), big, "none")).collect()] == ["v7", "none", "none"]


def test_row_local_operators_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    out = rules.apply(stream, [rules.Rule("o_orderstatus", "not_equals", "P")])
    out = recode.map_values(out, "o_orderpriority", {"1-URGENT": "urgent"}, "other")
    q = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = rules.apply(spark.read.parquet(f"{sf}/orders.parquet"), [rules.Rule("o_orderstatus", "not_equals", "P")])
    assert spark.table("streamed").count() == batch.count()


def test_hot_isolate(spark):
    """One isolate with very many lines still has one entry per drug."""
    n = 200_000
    tmp = tempfile.mkdtemp(prefix="panelstat-hot-")
    spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), F.when(F.col("id") % 2 == 0, "N").otherwise("A").alias("l_returnflag"),
    ).write.parquet(f"{tmp}/lineitem.parquet")
    spark.range(5).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), (F.col("id") + 1).cast("string")).alias("p_brand")).write.parquet(f"{tmp}/part.parquet")
    hot = warehouse.panels(spark, tmp).filter("isolate_id = 1").first()
    assert [(t.code, t.outcome) for t in hot.tests] == [(f"Brand#{i}", "I") for i in range(1, 6)]


def test_value_shares_count_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x"), (None, "y")], "p string, q string")
    got = {(r.dimension, r.value): (r.n, r.pct) for r in profile.value_shares(df, ["p", "q"], keep_null=["p"]).collect()}
    assert got == {("p", "a"): (2, 50.0), ("p", None): (2, 50.0), ("q", "x"): (2, 50.0), ("q", "y"): (1, 25.0)}


def test_prune(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, None, None)], "id int, e string, f string")
    assert coverage.drop_empty_columns(df).columns == ["id", "f"]
    assert coverage.prune_columns(df, 0.5).columns == ["id"]


def test_robustness_limits(spark):
    df = spark.createDataFrame([("a", "b", 0.2, 0.1)], "trigger string, target string, rd double, se double")
    r = post.robustness(df, F.lit(1000)).first()
    assert r.rv_q == pytest.approx(2 / np.sqrt(4 + 1000)) and 0 < r.rv_alpha < r.rv_q
    assert stats.normal_quantile(0.975) == pytest.approx(1.959963984540054)


def test_main_effects_models_match_least_squares(spark):
    rng = np.random.default_rng(6)
    cells = [f"{a}|{b}" for a in "xyz" for b in "uv"]
    rows = [(f, c, int(rng.integers(5, 30))) for f in range(3) for c in cells]
    tested = [(d, f, c, int(rng.integers(0, n + 1))) for d in ("A", "B") for f, c, n in rows]
    from panelstat.operators import nuisance

    got = nuisance.coefficients(
        spark.createDataFrame(rows, "fold int, cell string, wn int"),
        spark.createDataFrame(tested, "drug string, fold int, cell string, wy int"), [], ["drug"],
    )
    names = [nuisance.INTERCEPT] + [f"0={a}" for a in "xyz"] + [f"1={b}" for b in "uv"]
    design = lambda c: [1.0] + [float(c[0] == a) for a in "xyz"] + [float(c[2] == b) for b in "uv"]
    for r in got.collect():
        use = [(f, c, n) for f, c, n in rows if f != r.fold]
        y = {(f, c): t for d, f, c, t in tested if d == r.drug}
        x, w = np.array([design(c) for _, c, _ in use]), np.array([n for *_, n in use], float)
        mean = np.array([y[(f, c)] for f, c, _ in use]) / w
        expected = x @ np.linalg.lstsq(x * np.sqrt(w)[:, None], mean * np.sqrt(w), rcond=None)[0]
        assert x @ np.array([r.beta[f] for f in names]) == pytest.approx(expected, abs=1e-8)


def logistic_by_rows(design, n, y):
    """Newton's method on plain matrices."""
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.lstsq((design * (n * p * (1 - p))[:, None]).T @ design, design.T @ (y - n * p), rcond=1e-10)[0]
    return 1 / (1 + np.exp(-design @ beta))


@pytest.mark.parametrize("every", [True, False])
def test_logistic_models_match_newton_on_rows(spark, every):
    """All drugs, folds and keys at once against one fit each, with and without untested cells."""
    from panelstat.operators import logistic

    rng = np.random.default_rng(16)
    cells = [f"{a}|{b}|{c}" for a in "xyz" for b in "uv" for c in range(5)]
    counts = [(k, f, c, int(rng.integers(5, 40))) for k in (1, None) for f in range(3) for c in cells]
    tested = [(k, d, f, c, float(n), int(rng.binomial(n, 0.1 + 0.2 * (c[0] == "x") + 0.3 * (c[2] == "u")))) for d in "AB" for k, f, c, n in counts]
    tested = [t for t in tested if t[5] > 0]
    rows = spark.createDataFrame(tested, "key int, drug string, fold int, cell string, wn double, nt long")
    everyone = spark.createDataFrame(counts, "key int, fold int, cell string, n_all long")
    n = "" if every else "wn"
    got = logistic.cross_fitted(rows, ["key"], "drug", n, "nt", ["nt"], 3, "p", everyone if every else None).collect()
    assert len(got) == len(tested) and {(r.key, r.drug, r.fold, r.cell, r.nt) for r in got} == {(t[0], t[1], t[2], t[3], t[5]) for t in tested}
    design = lambda c: [float(c[0] == a) for a in "xyz"] + [float(c[2] == b) for b in "uv"] + [float(c[4] == str(k)) for k in range(5)]
    for key in (1, None):
        for drug in "AB":
            for fold in range(3):
                y = {(t[2], t[3]): t[5] for t in tested if t[0] == key and t[1] == drug}
                use = [(f, c, m) for k, f, c, m in counts if k == key and f != fold and (every or (f, c) in y)]
                x = np.array([design(c) for _, c, _ in use])
                p = logistic_by_rows(x, np.array([m for *_, m in use], float), np.array([y.get((f, c), 0) for f, c, _ in use], float))
                fitted = {c: v for (_, c, _), v in zip(use, p)}
                for r in got:
                    if (r.key, r.drug, r.fold) == (key, drug, fold) and r.cell in fitted:
                        assert r.p == pytest.approx(fitted[r.cell], abs=1e-5)


def test_newton_step_eliminates_the_widest_covariate():
    from panelstat.operators import logistic

    rng = np.random.default_rng(17)
    covariate = np.array([0] * 30 + [1] * 4 + [2] * 3)
    rows = np.stack([rng.integers(0, 29, 500), 30 + rng.integers(0, 4, 500), 34 + rng.integers(0, 3, 500)], axis=1)  # level 29 is unseen
    x = np.zeros((500, 37))
    np.put_along_axis(x, rows, 1.0, axis=1)
    w, r = rng.random(500), rng.normal(size=500)
    step = logistic.newton_step((x * w[:, None]).T @ x, x.T @ r, covariate)
    expected = np.linalg.lstsq((x * w[:, None]).T @ x, x.T @ r, rcond=1e-10)[0]
    assert x @ step == pytest.approx(x @ expected, abs=1e-8) and step[29] == 0
    assert (logistic.newton_step(np.zeros((3, 3)), np.zeros(3), np.zeros(3, int)) == 0).all()


def test_logistic_models_without_tests(spark):
    from panelstat.operators import logistic

    none = spark.createDataFrame([], "drug string, fold int, cell string, nt long")
    everyone = spark.createDataFrame([(0, "a|b", 3)], "fold int, cell string, n_all long")
    assert logistic.cross_fitted(none, [], "drug", "", "nt", ["nt"], 2, "p", everyone).collect() == []
    # a drug always tested and one never tested in a level: probabilities at the bounds, no failure
    rows = spark.createDataFrame([("A", f, c, 5) for f in (0, 1) for c in ("a|b", "c|b")] + [("B", f, "a|b", 5) for f in (0, 1)], none.schema)
    everyone = spark.createDataFrame([(f, c, 5) for f in (0, 1) for c in ("a|b", "c|b")], everyone.schema)
    got = {(r.drug, r.cell): r.p for r in logistic.cross_fitted(rows, [], "drug", "", "nt", ["nt"], 2, "p", everyone).collect()}
    assert min(got.values()) > 0.99


def test_isotonic_curves_match_spark_ml(spark):
    from pyspark.ml.regression import IsotonicRegression

    from panelstat.operators import policy

    rng = np.random.default_rng(18)
    rows = [(d, float(x) / 10_000, int(n), int(rng.binomial(n, min(1, x / 9_000)))) for d in "AB" for x, n in zip(rng.choice(9_000, 60, False), rng.integers(1, 30, 60))]
    df = spark.createDataFrame(rows, "code string, p double, n long, pos long")
    curves = policy.calibration_curves(df, ["code"])
    got = {(r.code, r.p): r.c for r in df.join(curves, "code").withColumn("c", policy.on_curve(F.col("p"), F.col("xs"), F.col("ys"))).collect()}
    for code in "AB":
        own = df.filter(F.col("code") == code).withColumn("y", F.col("pos") / F.col("n"))
        model = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="n").fit(own)
        for r in model.transform(own).collect():
            assert got[(code, r.p)] == pytest.approx(r.prediction, abs=1e-9)
        # the curve gives back the positive counts
        assert sum(n * got[(d, p)] for d, p, n, _ in rows if d == code) == pytest.approx(sum(r[3] for r in rows if r[0] == code))
    ends = spark.createDataFrame([(0.0, [0.2, 0.4], [0.1, 0.5]), (0.3, [0.2, 0.4], [0.1, 0.5]), (0.9, [0.2, 0.4], [0.1, 0.5]), (0.9, [0.2], [0.1])], "p double, xs array<double>, ys array<double>")
    assert [round(r[0], 9) for r in ends.select(policy.on_curve(F.col("p"), F.col("xs"), F.col("ys"))).collect()] == [0.1, 0.3, 0.5, 0.1]


def test_fitted_policy_of_all_drugs(spark):
    """Against one plain logistic fit per drug and left-out fold; contexts without tests are rows too."""
    from panelstat.operators import policy, splits

    rng = np.random.default_rng(19)
    contexts = [f"{a}|{b}" for a in "uvwxyz" for b in range(6)]
    rows = [(c, int(rng.integers(20, 90))) for c in contexts]
    tested = [(c, d, int(rng.binomial(n, 0.2 + 0.1 * (c[0] in "uv") + 0.08 * int(c[2])))) for d in "AB" for c, n in rows]
    tested = [t for t in tested if t[2] and t[0] != "z|5"]
    frames = spark.createDataFrame(tested, "context string, code string, n_tested long"), spark.createDataFrame(rows, "context string, n_rows long")
    got = {(r.context, r.code): r for r in policy.logistic_policy(*frames, "context", ["A", "B", "C"], calibrate=False).collect()}
    assert len(got) == 3 * len(contexts) and all(got[(c, "C")].p == 0.01 for c in contexts)
    fold = {r.context: r.fold for r in splits.with_fold(frames[1], "context", 3, 43).collect()}
    design = lambda c: [float(c[0] == a) for a in "uvwxyz"] + [float(c[2] == str(b)) for b in range(6)]
    y, n = {(c, d): t for c, d, t in tested}, dict(rows)
    for code in "AB":
        expected = dict.fromkeys(contexts, 0.0)
        for h in range(3):
            use = [c for c in contexts if fold[c] != h]
            x = np.array([design(c) for c in use])
            w, pos = np.array([n[c] for c in use], float), np.array([y.get((c, code), 0) for c in use], float)
            beta = np.zeros(12)
            for _ in range(50):
                p = 1 / (1 + np.exp(-x @ beta))
                beta += np.linalg.lstsq((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (pos - w * p), rcond=1e-10)[0]
            for c in contexts:
                expected[c] += 1 / (1 + np.exp(-np.array(design(c)) @ beta)) / 3
        seen = [c for c in contexts if all(any(fold[d] != h and d[at] == c[at] for d in contexts) for at in (0, 2) for h in range(3))]
        assert len(seen) > 20 and {c: got[(c, code)].p for c in seen} == pytest.approx({c: expected[c] for c in seen}, abs=1e-5)
    calibrated = policy.logistic_policy(*frames, "context", ["A", "B"]).collect()
    assert len(calibrated) == 2 * len(contexts) and all(0.01 <= r.p <= 0.99 for r in calibrated)
    off = lambda rows: sum((r.n_tested - r.n_rows * r.p) ** 2 / r.n_rows for r in rows)
    assert off(calibrated) < 1.5 * off([r for r in got.values() if r.code != "C"])


def test_fits_overlap_and_keep_their_order(spark):
    import threading

    from panelstat.operators import learners

    barrier = threading.Barrier(3, timeout=60)  # passes only if three run at once

    def work(k):
        barrier.wait()
        return spark.range(k).count()

    assert learners.together(spark, work, [1, 2, 3]) == [1, 2, 3]


def test_cross_fit_builds_models_in_one_thread(spark):
    import threading

    from panelstat.operators import learners

    rows = [(f, str(k), 1.0 + k, float(y)) for f in range(2) for k in range(2) for y in (0, 1)]
    df = spark.createDataFrame(rows, "fold int, ward string, n double, label double")
    df = learners.encoder(["ward"]).fit(df).transform(df)
    threads = set()

    def make():
        threads.add(threading.get_ident())
        return learners.build("logit", maxIter=3)

    assert learners.cross_fit(df, make, folds=2).count() == len(rows) and threads == {threading.get_ident()}


def test_default_model_adjusts_for_a_confounder(spark):
    """Age raises both resistance and testing; resistance itself changes nothing."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(12_000):
        old = bool(rng.random() < 0.5)
        r = int(rng.random() < (0.8 if old else 0.2))
        flags = [("A", r)] + ([("B", 0)] if rng.random() < (0.7 if old else 0.2) else [])
        rows.append((i, f"lab{i % 40}", f"w{i % 7}", "old" if old else "young", 2000 + i % 5, "g", flags))
    df = spark.createDataFrame(
        rows, "isolate_id long, lab string, ward string, age_group string, year int, pathogen_group string, flags array<struct<code:string,r:tinyint>>"
    )
    one = lambda s: effects.estimate_pairs(df, ["A", "B"], s, pairs=[("A", "B")]).first()
    context = ("pathogen_group",)
    adjusted, thin = one(effects.EffectSettings(context=context)), one(effects.EffectSettings(context=context, nuisance="saturated"))
    assert abs(adjusted.rd) < 4 * adjusted.se < abs(thin.rd)


def test_weighted_percentiles_equal_spark(spark):
    shares = [0.0, 0.01, 0.333, 0.5, 0.99, 1.0]
    df = spark.range(60_000).selectExpr("id % 3 AS k", "CASE WHEN id % 7 = 0 THEN 0.25 WHEN id % 1000 = 1 THEN 1e300 * id ELSE exp(rand(3) * 40 - 20) - 1 END AS v", "id % 4 AS n")
    df = df.unionAll(spark.sql("SELECT 5L, 2.5D, 1L UNION ALL SELECT 5L, 3.5D, 1L UNION ALL SELECT 6L, CAST(NULL AS DOUBLE), 4L UNION ALL SELECT 7L, -1e308D, 2L UNION ALL SELECT 7L, 1e308D, 2L"))
    df = session.checkpoint(df)
    for keys in (["k"], []):
        good = df.where("v IS NOT NULL AND n > 0").groupBy(*keys)
        expected = sorted(map(tuple, good.agg(F.percentile("v", F.array(*[F.lit(q) for q in shares]), F.col("n"))).collect()))
        for bound in (10, 10**6):
            got = quantiles.weighted(df, keys, "v", "n", shares, "q", max_values=bound)
            assert sorted(map(tuple, got.collect())) == expected
    assert quantiles.weighted(df.limit(0), ["k"], "v", "n", shares, "q", max_values=10).count() == 0


def test_weighted_percentiles_of_a_million_values(spark):
    df = spark.range(1_000_000).selectExpr("id * 0.5 AS v", "1L AS n")
    assert quantiles.weighted(df, [], "v", "n", [0.25, 0.9], "q").first().q == [124999.875, 449999.55]


def test_a_failed_write_leaves_the_stored_rows(spark, scratch):
    folder = writers.dataset_path(scratch, "processed", "kept", "parquet")
    first = writers.save_dataset(spark.range(3), scratch, "kept")
    broken = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        writers.save_dataset(broken.repartition(2), scratch, "kept")
    assert readers.read_any(spark, folder).count() == 3 and len(os.listdir(folder)) == len([".crc", "_current.json", "v"])
    reading = readers.read_any(spark, folder)
    second = writers.save_dataset(spark.range(5), scratch, "kept")
    assert reading.count() == 3 and readers.read_any(spark, folder).count() == 5
    writers.save_dataset(spark.range(6), scratch, "kept")
    assert not os.path.exists(first) and os.path.exists(second) and readers.read_any(spark, folder).count() == 6
    writers.save_dataset(spark.range(4), scratch, "kept", fmt="csv")
    assert readers.read_any(spark, writers.dataset_path(scratch, "processed", "kept", "csv")).count() == 4


def test_arrow_files_are_split_pruned_and_filtered(spark, scratch):
    df = spark.range(1_000).selectExpr("id", "IF(id % 3 = 0, NULL, CAST(id % 5 AS STRING)) AS k", "id * 0.5 AS x").coalesce(1)
    writers.save_arrow(df, f"{scratch}/a", rows_per_batch=100)
    back = arrow_source.read(spark, f"{scratch}/a", batches_per_partition=3)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 1_000
    remote = arrow_source.read(spark, f"file://{scratch}/a", ["k"], source="true")
    assert remote.columns == ["__source__", "k"] and remote.first()[0].startswith("file://")
    for where in ("k = '2'", "k > '2'", "k <= '1'", "k IN ('1', '4')", "k IS NULL", "k IS NOT NULL AND x = '1.0'", "k <=> NULL", "length(k) = 1"):
        assert back.where(where).count() == df.selectExpr("CAST(id AS STRING) id", "k", "CAST(x AS STRING) x").where(where).count()
    with pytest.raises(FileExistsError):
        writers.save_arrow(df, f"{scratch}/a")
