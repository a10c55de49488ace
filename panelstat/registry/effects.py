"""Split, policy, score, weight and effect queries. The oracles work on rows, not on cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat import session
from panelstat.functions import stats
from panelstat.operators import effects, logistic, nuisance, pairs, panel, policy, rules, splits
from panelstat.registry import base
from panelstat.registry.pairs import FISHER_CTES, OR_COLS, PAIR_CTES, rounded
from panelstat.registry.rules import COHORT_FAMILY_CTE, COHORTS
from panelstat.sources import warehouse

SETTINGS = effects.EffectSettings(
    covariates=("ward", "care_type"), context=("pathogen_group", "year"), min_context_n=280, min_cell_n=10, nuisance="saturated"
)


def _flagged(spark, sf):
    return panel.with_flags(warehouse.isolates(spark, sf), recode_mode="R_vs_nonR", drop_i=True)


def _rounded(df):
    return rounded(df, **{c: 6 for c, t in df.dtypes if t == "double"})


# ---- splits ------------------------------------------------------------------------------------


def lab_split(spark, sf):
    df = splits.group_split(warehouse.meta(spark, sf).select("isolate_id", "lab"), "lab", 0.3)
    return df.groupBy("lab", "is_test").agg(F.count(F.lit(1)).alias("n"))


LAB_SPLIT = """split AS (SELECT lab, row_number() OVER (ORDER BY md5('42|' || lab), lab) <= ceil(0.3 * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT lab FROM {0}))"""


def row_split_and_folds(spark, sf):
    df = warehouse.table(spark, sf, "orders").select("o_orderkey")
    df = splits.with_fold(splits.row_split(df, "o_orderkey", 0.3), "o_orderkey", 5)
    return df.select("o_orderkey", "is_test", "fold")


HASH = base.hash_bucket("'42|' || CAST({0} AS VARCHAR)")
FOLD_SQL = f"""SELECT o_orderkey, {HASH.format('o_orderkey')} < {int(round(0.3 * 16**8))} AS is_test,
  CAST({HASH.format('o_orderkey')} % 5 AS INTEGER) AS fold FROM orders"""


# ---- the estimation model as row-level SQL -------------------------------------------------------

BASE = base.with_(base.TESTS, base.META, base.ISO, base.FLAGS)[:-1]


def model_ctes(frame: str = "iso", key: str | None = None, s: effects.EffectSettings = SETTINGS) -> str:
    """CTEs d (test isolates), score, tr (trigger rows with w and g1) for one optional key column."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    on = lambda a, b: f" AND {a}.{key} = {b}.{key}" if key else ""
    cell = " || '|' || ".join(f"coalesce(CAST(i.{c} AS VARCHAR), 'NA')" for c in s.covariates)
    ctx = " || '|' || ".join(f"coalesce(CAST(i.{c} AS VARCHAR), 'NA')" for c in s.context)
    q = s.cap_percentile / 100
    lo, hi = s.min_prob, 1 - s.min_prob
    return f"""
split AS (SELECT *, row_number() OVER ({part}ORDER BY md5('{s.seed}|' || lab), lab) <= ceil({s.test_size} * count(*) OVER ({part})) AS is_test
  FROM (SELECT DISTINCT {k}lab FROM {frame})),
e AS (SELECT i.isolate_id, {'i.' + key + ', ' if key else ''}is_test, {cell} AS cell, {ctx} AS context, {HASH.format('i.isolate_id')} % {s.n_folds} AS fold
  FROM {frame} i JOIN split sp ON sp.lab = i.lab{on('sp', 'i')}),
train AS (SELECT * FROM e WHERE NOT is_test),
d AS (SELECT * FROM e WHERE is_test),
ctx_n AS (SELECT {k}context, count(*) AS n FROM train GROUP BY {k}context),
tot_n AS (SELECT {k}count(*) AS n FROM train {'GROUP BY ' + key if key else ''}),
ctx_t AS (SELECT {k}context, code, count(*) AS t FROM train JOIN flags USING (isolate_id) GROUP BY {k}context, code),
def AS (SELECT {'c.' + key + ', ' if key else ''}code, sum(t) / max(n) AS p FROM ctx_t c JOIN tot_n n ON true{on('c', 'n')} GROUP BY {'c.' + key + ', ' if key else ''}code),
df AS (SELECT d.*, f.code, f.r FROM d JOIN flags f USING (isolate_id)),
pol AS (SELECT df.*, least(greatest(coalesce(CASE WHEN n.n >= {s.min_context_n} THEN coalesce(t.t, 0) / n.n END, dd.p, 0), {lo}), {hi}) AS p
  FROM df LEFT JOIN ctx_n n ON n.context = df.context{on('n', 'df')}
  LEFT JOIN ctx_t t ON t.context = df.context AND t.code = df.code{on('t', 'df')}
  LEFT JOIN def dd ON dd.code = df.code{on('dd', 'df')}),
caps AS (SELECT {k}code, quantile_cont(1 / p, {q}) AS cap FROM pol GROUP BY {k}code),
score AS (SELECT pol.*, 1 / p AS raw_score, cap, least(1 / p, cap) AS score FROM pol JOIN caps c ON c.code = pol.code{on('c', 'pol')}),
ac AS (SELECT {k}cell, fold, count(*) AS n FROM d GROUP BY {k}cell, fold),
tc AS (SELECT {k}code, cell, fold, count(*) AS n, sum(r) AS n1 FROM df GROUP BY {k}code, cell, fold),
tx AS (SELECT tc.*, 
    (SELECT coalesce(sum(n), 0) FROM ac x WHERE x.cell = tc.cell AND x.fold <> tc.fold{on('x', 'tc')}) AS all_out,
    (SELECT coalesce(sum(n), 0) FROM ac x WHERE x.fold <> tc.fold{on('x', 'tc')}) AS all_f,
    (SELECT coalesce(sum(n), 0) FROM tc x WHERE x.code = tc.code AND x.cell = tc.cell AND x.fold <> tc.fold{on('x', 'tc')}) AS nt_out,
    (SELECT coalesce(sum(n), 0) FROM tc x WHERE x.code = tc.code AND x.fold <> tc.fold{on('x', 'tc')}) AS nt_f FROM tc),
tp AS (SELECT *, least(greatest(coalesce(CASE WHEN all_out >= {s.min_cell_n} THEN nt_out / all_out ELSE nt_f / nullif(all_f, 0) END, 0.5), {lo}), {hi}) AS p_test FROM tx),
tcap AS (SELECT {'tp.' + key + ', ' if key else ''}tp.code, quantile_cont(1 / p_test, {q}) AS w_cap FROM tp JOIN df ON df.code = tp.code AND df.cell = tp.cell AND df.fold = tp.fold{on('df', 'tp')} GROUP BY {'tp.' + key + ', ' if key else ''}tp.code),
tw AS (SELECT tp.*, w_cap, least(1 / p_test, w_cap) AS w FROM tp JOIN tcap c ON c.code = tp.code{on('c', 'tp')}),
tg AS (SELECT tw.*,
    (SELECT coalesce(sum(w * n1), 0) FROM tw x WHERE x.code = tw.code AND x.cell = tw.cell AND x.fold <> tw.fold{on('x', 'tw')}) AS wr_out,
    (SELECT coalesce(sum(w * n), 0) FROM tw x WHERE x.code = tw.code AND x.cell = tw.cell AND x.fold <> tw.fold{on('x', 'tw')}) AS wt_out,
    (SELECT sum(w * n1) / sum(w * n) FROM tw x WHERE x.code = tw.code AND x.fold <> tw.fold{on('x', 'tw')}) AS g_f FROM tw),
gg AS (SELECT *, least(greatest(coalesce(CASE WHEN nt_out >= {s.min_cell_n} THEN wr_out / wt_out ELSE g_f END, 0.5), {lo}), {hi}) AS g1 FROM tg),
tr AS (SELECT {'df.' + key + ', ' if key else ''}df.isolate_id, df.code AS trigger, df.r AS a, df.cell, df.fold, g.p_test, g.w, g.w_cap, g.g1
  FROM df JOIN gg g ON g.code = df.code AND g.cell = df.cell AND g.fold = df.fold{on('g', 'df')})"""


def estimate_ctes(key: str | None = None, s: effects.EffectSettings = SETTINGS, pair_cte: str | None = None) -> str:
    """CTE est: the targeted estimator on rows; needs model_ctes."""
    k = f"{key}, " if key else ""
    rk = f"r.{key}, " if key else ""
    on = lambda a, b: f" AND {a}.{key} = {b}.{key}" if key else ""
    catalogue = pair_cte or f"allp AS (SELECT x.code AS trigger, y.code AS target FROM (VALUES {base.CODE_VALUES}) x(code), (VALUES {base.CODE_VALUES}) y(code) WHERE x.code <> y.code)"
    return f""", {catalogue},
yr AS (SELECT {rk}r.isolate_id, r.trigger, q.target, r.a, r.cell, r.fold, r.w, r.g1, coalesce(s.score, 0) AS y
  FROM tr r JOIN allp q ON q.trigger = r.trigger LEFT JOIN score s ON s.isolate_id = r.isolate_id AND s.code = q.target{on('s', 'r')}),
qc AS (SELECT {k}trigger, target, cell, fold, a, sum(w * y) AS wy, sum(w) AS w, count(*) AS n FROM yr GROUP BY {k}trigger, target, cell, fold, a),
qcell AS (SELECT {k}trigger, target, cell, a, sum(wy) AS wy, sum(w) AS w, sum(n) AS n FROM qc GROUP BY {k}trigger, target, cell, a),
qfold AS (SELECT {k}trigger, target, fold, a, sum(wy) AS wy, sum(w) AS w FROM qc GROUP BY {k}trigger, target, fold, a),
qall AS (SELECT {k}trigger, target, a, sum(wy) AS wy, sum(w) AS w FROM qc GROUP BY {k}trigger, target, a),
cf AS (SELECT DISTINCT {k}trigger, target, cell, fold, arm.a FROM yr, (VALUES (0), (1)) arm(a)),
qq AS (SELECT {'cf.' + key + ', ' if key else ''}cf.trigger, cf.target, cf.cell, cf.fold, cf.a,
    CASE WHEN coalesce(c.n, 0) - coalesce(o.n, 0) >= {s.min_cell_n} THEN (c.wy - coalesce(o.wy, 0)) / (c.w - coalesce(o.w, 0))
         ELSE (al.wy - coalesce(f.wy, 0)) / nullif(al.w - coalesce(f.w, 0), 0) END AS q
  FROM cf LEFT JOIN qcell c ON c.trigger = cf.trigger AND c.target = cf.target AND c.cell = cf.cell AND c.a = cf.a{on('c', 'cf')}
  LEFT JOIN qc o ON o.trigger = cf.trigger AND o.target = cf.target AND o.cell = cf.cell AND o.fold = cf.fold AND o.a = cf.a{on('o', 'cf')}
  LEFT JOIN qfold f ON f.trigger = cf.trigger AND f.target = cf.target AND f.fold = cf.fold AND f.a = cf.a{on('f', 'cf')}
  LEFT JOIN qall al ON al.trigger = cf.trigger AND al.target = cf.target AND al.a = cf.a{on('al', 'cf')}),
z AS (SELECT r.*, coalesce(a1.q, 0) AS q1, coalesce(a0.q, 0) AS q0, CASE WHEN r.a = 1 THEN 1 / g1 ELSE -1 / (1 - g1) END AS h, CASE WHEN r.a = 1 THEN coalesce(a1.q, 0) ELSE coalesce(a0.q, 0) END AS qa
  FROM yr r JOIN qq a1 ON a1.trigger = r.trigger AND a1.target = r.target AND a1.cell = r.cell AND a1.fold = r.fold AND a1.a = 1{on('a1', 'r')}
  JOIN qq a0 ON a0.trigger = r.trigger AND a0.target = r.target AND a0.cell = r.cell AND a0.fold = r.fold AND a0.a = 0{on('a0', 'r')}),
ep AS (SELECT {k}trigger, target, sum(w * h * (y - qa)) / sum(w * h * h) AS eps, avg(w) AS mw, sum(w) AS sw FROM z GROUP BY {k}trigger, target),
st AS (SELECT z.*, eps, mw, q1 + eps / g1 - q0 + eps / (1 - g1) AS diff, qa + eps * h AS qs FROM z JOIN ep ON ep.trigger = z.trigger AND ep.target = z.target{on('ep', 'z')}),
ps AS (SELECT {k}trigger, target, sum(w * diff) / sum(w) AS psi FROM st GROUP BY {k}trigger, target),
ic AS (SELECT st.*, psi, w / mw * (h * (y - qs) + diff - psi) AS ic FROM st JOIN ps ON ps.trigger = st.trigger AND ps.target = st.target{on('ps', 'st')}),
est AS (SELECT {k}trigger, target, max(psi) AS rd, sqrt(var_samp(ic) / count(*)) AS se, max(eps) AS epsilon, sum(w) * sum(w) / sum(w * w) AS ess,
    count(*) AS n_used, CAST(sum(a) AS BIGINT) AS n_A1, CAST(sum(1 - a) AS BIGINT) AS n_A0, sum(w * q0) / sum(w) AS baseline_mu0,
    sum(w * y) / sum(w) AS escalation_score_mean, avg(w) AS weights_mean FROM ic GROUP BY {k}trigger, target),
gated AS (SELECT *, CASE WHEN n_used < {s.min_tested} THEN 'tested: ' || n_used || ', at least {s.min_tested} wanted'
    WHEN n_A1 < {s.min_group} OR n_A0 < {s.min_group} THEN 'arms: ' || n_A1 || ' and ' || n_A0 || ', at least {s.min_group} wanted' ELSE '' END AS skip_reason,
    rd / se AS zz FROM est),
final AS (SELECT {k}trigger, target, skip_reason, CASE WHEN skip_reason = '' THEN 'ok' ELSE 'failed' END AS status, n_A1, n_A0, n_A1 + n_A0 AS n_trigger_tested,
    CASE WHEN skip_reason = '' THEN n_used ELSE 0 END AS n_used,
    CASE WHEN skip_reason = '' THEN rd END AS rd, CASE WHEN skip_reason = '' THEN se END AS se, CASE WHEN skip_reason = '' THEN epsilon END AS epsilon,
    CASE WHEN skip_reason = '' THEN ess END AS ess, CASE WHEN skip_reason = '' THEN baseline_mu0 END AS baseline_mu0,
    CASE WHEN skip_reason = '' THEN escalation_score_mean END AS escalation_score_mean, CASE WHEN skip_reason = '' THEN weights_mean END AS weights_mean,
    CASE WHEN skip_reason = '' THEN rd - {stats.normal_quantile(0.975)!r} * se END AS ci_low, CASE WHEN skip_reason = '' THEN rd + {stats.normal_quantile(0.975)!r} * se END AS ci_high,
    CASE WHEN skip_reason = '' THEN 2 * ({base.tail('zz')}) END AS p_value FROM gated)"""


def final_select(key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in effects.ESTIMATES)
    return f"\nSELECT {k}trigger, target, skip_reason, status, n_A1, n_A0, n_trigger_tested, n_used, {cols} FROM final"


def pair_effects(spark, sf):
    """Every ordered pair of the catalogue."""
    return _rounded(effects.estimate_pairs(_flagged(spark, sf), warehouse.CODES, SETTINGS))


PAIR_SQL = BASE + "," + model_ctes() + estimate_ctes() + final_select()


def routine_policy(spark, sf):
    train, test = effects.train_test(_flagged(spark, sf), SETTINGS)
    out = policy.empirical_policy(train, test, "context", SETTINGS.min_context_n, SETTINGS.min_prob)
    return _rounded(out.select("context", "code", "n_tested", "p"))


POLICY_SQL = BASE + "," + model_ctes() + "\nSELECT context, code, count(*) AS n_tested, round(max(p), 6) AS p FROM pol GROUP BY context, code"


def escalation_score(spark, sf):
    train, test = effects.train_test(_flagged(spark, sf), SETTINGS)
    pol = policy.empirical_policy(train, test, "context", SETTINGS.min_context_n, SETTINGS.min_prob)
    return _rounded(policy.escalation_scores(pol).select("context", "code", "n_tested", "raw_score", "cap", "score"))


SCORE_SQL = BASE + "," + model_ctes() + """
SELECT context, code, count(*) AS n_tested, round(max(raw_score), 6) AS raw_score, round(max(cap), 6) AS cap, round(max(score), 6) AS score FROM score GROUP BY context, code"""


def _calibration(spark, sf):
    train, test = effects.train_test(_flagged(spark, sf), SETTINGS)
    cells = policy.calibration_cells(train, test, "context", warehouse.CODES, SETTINGS.min_context_n, SETTINGS.min_prob)
    return policy.calibration(cells)


def policy_brier(spark, sf):
    return _rounded(_calibration(spark, sf)[0])


def policy_reliability(spark, sf):
    return _rounded(_calibration(spark, sf)[1])


CALIBRATION = BASE + "," + model_ctes() + f""",
cal AS (SELECT c.code, CASE WHEN f.code IS NULL THEN 0 ELSE 1 END AS y,
    least(greatest(coalesce(CASE WHEN n.n >= {SETTINGS.min_context_n} THEN coalesce(t.t, 0) / n.n END, dd.p, 0), {SETTINGS.min_prob}), {1 - SETTINGS.min_prob}) AS p
  FROM d CROSS JOIN (VALUES {base.CODE_VALUES}) c(code) LEFT JOIN flags f ON f.isolate_id = d.isolate_id AND f.code = c.code
  LEFT JOIN ctx_n n ON n.context = d.context LEFT JOIN ctx_t t ON t.context = d.context AND t.code = c.code LEFT JOIN def dd ON dd.code = c.code)
"""
BRIER_SQL = CALIBRATION + "SELECT code, round(avg((p - y) * (p - y)), 6) AS brier_score, count(*) AS n_rows FROM cal GROUP BY code"
RELIABILITY_SQL = CALIBRATION + """SELECT code, CAST(greatest(ceil(round(p * 10, 9)) - 1, 0) AS INTEGER) AS bin, round(avg(y), 6) AS prob_true, round(avg(p), 6) AS prob_pred,
  count(*) AS n_rows FROM cal GROUP BY 1, 2"""


def _trigger_cells(spark, sf):
    tested, rows = effects.test_counts(_flagged(spark, sf), SETTINGS)
    return effects.trigger_cells(tested, rows, [], SETTINGS)


def testing_weights(spark, sf):
    return _rounded(_trigger_cells(spark, sf).select("trigger", "fold", "cell", "n1", "n0", "p_test", "w", "g1"))


WEIGHTS_SQL = BASE + "," + model_ctes() + """
SELECT trigger, CAST(fold AS INTEGER) AS fold, cell, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(1 - a) AS BIGINT) AS n0, round(max(p_test), 6) AS p_test, round(max(w), 6) AS w, round(max(g1), 6) AS g1
FROM tr GROUP BY trigger, fold, cell"""


def weight_diagnostics(spark, sf):
    return _rounded(effects.weight_diagnostics(_trigger_cells(spark, sf), []))


QS = {"q00": 0.0, "q01": 0.01, "q50": 0.5, "q99": 0.99, "q100": 1.0}
DIAG_SQL = BASE + "," + model_ctes() + "\nSELECT trigger, " + ", ".join(
    f"round(quantile_cont({v}, {q}), 6) AS {p}_{n}" for v, p in (("p_test", "p"), ("w", "w")) for n, q in QS.items()
) + ", round(max(w_cap), 6) AS w_cap, round(sum(w) * sum(w) / sum(w * w), 6) AS ess, count(*) AS n_tested FROM tr GROUP BY trigger"


KEYED_SETTINGS = effects.EffectSettings(
    covariates=("ward", "care_type"), context=("pathogen_group",), min_context_n=100, min_cell_n=10, min_tested=60, min_group=20, nuisance="saturated"
)


DEFAULT = effects.EffectSettings()


def pair_effects_default(spark, sf):
    """All four covariates, the (lab, group, year) context and cross-fitted main-effects models: the settings a user gets."""
    return _rounded(effects.estimate_pairs(_flagged(spark, sf), warehouse.CODES, DEFAULT))


def testing_model_margins(spark, sf):
    """Fitted tests per drug, held-out fold and covariate level: a logistic fit reproduces the observed ones."""
    tested, rows = effects.test_counts(_flagged(spark, sf), DEFAULT)
    cells = session.checkpoint(logistic.cell_rows(tested, [], "trigger", "", "nt", [], rows, DEFAULT.n_folds))
    drugs = [r[0] for r in tested.select("trigger").distinct().collect()]
    model = logistic.fit(cells, [], drugs, DEFAULT.n_folds)
    fitted = logistic.predict_everywhere(cells, [], model, "trigger").select(
        "trigger", "fold", F.explode(nuisance.level_features(F.col("cell"))).alias("feature"), (F.col("n") * F.col("p")).alias("np")
    )
    sums = fitted.groupBy("trigger", "fold", "feature").agg(F.sum("np").alias("n_tested"))
    return sums.withColumn("n_tested", F.round("n_tested", 3)).filter("n_tested > 0.5")


MARGINS_SQL = BASE + "," + model_ctes("iso", None, DEFAULT) + """
SELECT code AS trigger, CAST(h AS INTEGER) AS fold, feature, CAST(count(*) AS DOUBLE) AS n_tested
FROM (SELECT code, fold, unnest(['(Intercept)', '0=' || split_part(cell, '|', 1), '1=' || split_part(cell, '|', 2),
        '2=' || split_part(cell, '|', 3), '3=' || split_part(cell, '|', 4)]) AS feature FROM df) x, range(5) r(h)
WHERE fold <> h GROUP BY ALL"""


def yearly_effects(spark, sf):
    """Re-estimation per year: the year is one more key of the same plan."""
    return _rounded(effects.estimate_pairs(_flagged(spark, sf), warehouse.CODES, KEYED_SETTINGS, keys=["year"]))


YEARLY_SQL = BASE + "," + model_ctes("iso", "year", KEYED_SETTINGS) + estimate_ctes("year", KEYED_SETTINGS) + final_select("year")

COHORT_SETTINGS = effects.EffectSettings(
    covariates=("care_type",), context=("ward",), min_context_n=100, min_cell_n=10, min_tested=60, min_group=20, nuisance="saturated"
)


def cohort_effects(spark, sf):
    """All cohorts in one job: the cohort name is a key of the plan."""
    df = rules.assign_cohorts(_flagged(spark, sf), COHORTS)
    return _rounded(effects.estimate_pairs(df, warehouse.CODES, COHORT_SETTINGS, keys=["cohort"]))


COHORT_SQL = (
    BASE + ", " + COHORT_FAMILY_CTE + "," + model_ctes("cohorts", "cohort", COHORT_SETTINGS)
    + estimate_ctes("cohort", COHORT_SETTINGS) + final_select("cohort")
)


def bounded_effects(spark, sf):
    return _rounded(effects.bounded_effects(_flagged(spark, sf), warehouse.CODES, SETTINGS))


def logit_sql(x: str) -> str:
    return f"ln(({x} + 0.0001) / (1 - {x} + 0.0001))"


BOUNDED_SQL = BASE + "," + model_ctes() + estimate_ctes() + f""",
sp2 AS (SELECT trigger, target, max(y) AS span FROM z GROUP BY trigger, target),
b0 AS (SELECT z.*, span, {logit_sql('(qa / span)')} AS off, {logit_sql('(y / span)')} AS yl FROM z JOIN sp2 USING (trigger, target) WHERE span > 0),
b1 AS (SELECT trigger, target, sum(w * h * (yl - off)) / sum(w * h * h) AS eps FROM b0 GROUP BY trigger, target),
b2 AS (SELECT b0.*, eps, span / (1 + exp(-(off + eps / g1))) AS q1s, span / (1 + exp(-(off - eps / (1 - g1)))) AS q0s FROM b0 JOIN b1 USING (trigger, target)),
b3 AS (SELECT trigger, target, sum(w * (q1s - q0s)) / sum(w) AS psi, avg(w) AS mw FROM b2 GROUP BY trigger, target),
b4 AS (SELECT b2.*, psi, w / mw * (h * (y - CASE WHEN a = 1 THEN q1s ELSE q0s END) + q1s - q0s - psi) AS ic FROM b2 JOIN b3 USING (trigger, target)),
b5 AS (SELECT trigger, target, max(psi) AS rd, max(eps) AS epsilon, sqrt(var_samp(ic) / count(*)) AS se, count(*) AS n_used FROM b4 GROUP BY trigger, target),
b6 AS (SELECT *, rd / se AS zb FROM b5)
SELECT trigger, target, round(rd, 6) AS rd, round(se, 6) AS se, round(rd - 1.96 * se, 6) AS ci_low, round(rd + 1.96 * se, 6) AS ci_high,
  round(2 * ({base.tail('zb')}), 6) AS p_value, round(epsilon, 6) AS epsilon, n_used FROM b6"""


def _discovery(spark, sf):
    """Half of the laboratories for screening, the other half for estimation. The isolates are written
    once: the split, the screen and each pass of the estimates read them."""
    used = dict.fromkeys([SETTINGS.key, SETTINGS.group_col, *SETTINGS.covariates, *SETTINGS.context, "flags"])
    rows = session.checkpoint(_flagged(spark, sf).select(*used))
    return splits.group_split(rows, "lab", 0.5, seed=7, out="is_estimation")


def screened_effects(spark, sf):
    """Screen on discovery laboratories, estimate the selected pairs on the others."""
    df = _discovery(spark, sf)
    chosen = session.checkpoint(pairs.screen(df.filter(~F.col("is_estimation")), top_n=100))
    return _rounded(effects.estimate_pairs(df.filter("is_estimation"), warehouse.CODES, SETTINGS, pairs=chosen))


SCREENED_SQL = (
    BASE
    + """,
sp0 AS (SELECT lab, row_number() OVER (ORDER BY md5('7|' || lab), lab) <= ceil(0.5 * count(*) OVER ()) AS is_est FROM (SELECT DISTINCT lab FROM iso)),
ei AS (SELECT iso.* FROM iso JOIN sp0 USING (lab) WHERE is_est),
dflags AS (SELECT f.* FROM flags f JOIN iso USING (isolate_id) JOIN sp0 USING (lab) WHERE NOT is_est),
"""
    + PAIR_CTES.replace("flags", "dflags") + ",\n" + FISHER_CTES.replace("gated", "sgated")
    + f""", kept AS (SELECT g.*, f.p_value, {OR_COLS} FROM sgated g JOIN fisher f USING (trigger, target) WHERE f.p_value <= 0.05),
rk AS (SELECT *, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS m FROM kept),
bh AS (SELECT *, least(1.0, min(p_value * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) <= 0.05 AS sig FROM rk),
chosen AS (SELECT trigger, target FROM bh ORDER BY sig DESC, abs(ln(ratio)) DESC, trigger, target LIMIT 100),"""
    + model_ctes("ei")
    + estimate_ctes(pair_cte="allp AS (SELECT * FROM chosen)")
    + final_select()
)


def failure_summary(spark, sf):
    """Failed pairs with their group sizes, under gates that fail many of them."""
    s = effects.EffectSettings(covariates=("ward", "care_type"), context=("pathogen_group", "year"), min_context_n=280, min_cell_n=10, min_tested=560, min_group=210, nuisance="saturated")
    out = effects.estimate_pairs(_flagged(spark, sf), warehouse.CODES, s).filter(F.col("status") == "failed")
    sized = F.col("skip_reason").startswith("arms")
    return out.select("trigger", "target", "skip_reason", F.when(sized, F.col("n_A1")).alias("n1_failed"), F.when(sized, F.col("n_A0")).alias("n0_failed"))


FAIL_SETTINGS = effects.EffectSettings(covariates=("ward", "care_type"), context=("pathogen_group", "year"), min_context_n=280, min_cell_n=10, min_tested=560, min_group=210, nuisance="saturated")
FAIL_SQL = BASE + "," + model_ctes(s=FAIL_SETTINGS) + estimate_ctes(s=FAIL_SETTINGS) + """
SELECT trigger, target, skip_reason, CASE WHEN skip_reason LIKE 'arms%' THEN n_A1 END AS n1_failed, CASE WHEN skip_reason LIKE 'arms%' THEN n_A0 END AS n0_failed FROM final WHERE status = 'failed'"""

QUERIES = {
    "lab_split": (
        lab_split,
        base.with_(base.META, LAB_SPLIT.format("meta")) + "SELECT m.lab, is_test, count(*) AS n FROM meta m JOIN split s ON s.lab = m.lab GROUP BY 1, 2",
    ),
    "row_split_and_folds": (row_split_and_folds, FOLD_SQL),
    "routine_policy": (routine_policy, POLICY_SQL),
    "escalation_score": (escalation_score, SCORE_SQL),
    "policy_brier": (policy_brier, BRIER_SQL),
    "policy_reliability": (policy_reliability, RELIABILITY_SQL),
    "testing_weights": (testing_weights, WEIGHTS_SQL),
    "weight_diagnostics": (weight_diagnostics, DIAG_SQL),
    "pair_effects": (pair_effects, PAIR_SQL),
    "pair_effects_default": (pair_effects_default, None),
    "testing_model_margins": (testing_model_margins, MARGINS_SQL),
    "yearly_effects": (yearly_effects, YEARLY_SQL),
    "cohort_effects": (cohort_effects, COHORT_SQL),
    "bounded_effects": (bounded_effects, BOUNDED_SQL),
    "screened_effects": (screened_effects, SCREENED_SQL),
    "failure_summary": (failure_summary, FAIL_SQL),
}
