"""Pair screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import stats
from panelstat.operators import pairs, panel
from panelstat.registry import base
from panelstat.sources import warehouse


def _flagged(spark, sf):
    return panel.with_flags(warehouse.panels(spark, sf), recode_mode="R_vs_nonR", drop_i=True)


def rounded(df, **digits):
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


PAIR_CTES = """margin AS (
  SELECT code, CAST(sum(r) AS BIGINT) AS n_r, CAST(count(*) - sum(r) AS BIGINT) AS n_s FROM flags GROUP BY code),
joint AS (
  SELECT x.code AS trigger, y.code AS target, CAST(sum(x.r) AS BIGINT) AS a, CAST(sum(1 - x.r) AS BIGINT) AS c
  FROM flags x JOIN flags y ON x.isolate_id = y.isolate_id AND x.code <> y.code GROUP BY x.code, y.code),
tab AS (
  SELECT m.code AS trigger, t.code AS target, coalesce(j.a, 0) AS a, m.n_r - coalesce(j.a, 0) AS b,
         coalesce(j.c, 0) AS c, m.n_s - coalesce(j.c, 0) AS d, m.n_r + m.n_s AS n_trigger_tested,
         m.n_r AS n_A_R, m.n_s AS n_A_S
  FROM margin m JOIN margin t ON m.code <> t.code LEFT JOIN joint j ON j.trigger = m.code AND j.target = t.code)"""

FISHER_CTES = """gated AS (SELECT * FROM tab WHERE n_trigger_tested >= 100 AND n_A_R >= 50 AND n_A_S >= 50),
logs AS (
  SELECT g.trigger, g.target, x,
         -lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp,
         -lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS lobs
  FROM gated g, unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS u(x)),
fisher AS (
  SELECT trigger, target, least(1.0, sum(CASE WHEN lp - lobs <= 1e-7 THEN exp(lp - lobs) ELSE 0 END) / sum(exp(lp - lobs))) AS p_value
  FROM logs GROUP BY trigger, target)"""

OR_COLS = """(a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)) AS ratio,
  sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)) AS se_log"""

SCREEN_SQL = (
    base.with_(base.TESTS, base.FLAGS, PAIR_CTES, FISHER_CTES)
    + f""", kept AS (
  SELECT g.*, f.p_value, {OR_COLS} FROM gated g JOIN fisher f USING (trigger, target) WHERE f.p_value <= 0.05),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS m FROM kept),
bh AS (
  SELECT *, least(1.0, min(p_value * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q_value
  FROM ranked)
SELECT trigger, target, round(ratio, 6) AS or_unadjusted, round(exp(ln(ratio) - 1.96 * se_log), 6) AS or_ci_low,
  round(exp(ln(ratio) + 1.96 * se_log), 6) AS or_ci_high, round(p_value, 6) AS p_value,
  round(a / (a + b) - c / (c + d), 6) AS delta, round(a / (a + b), 6) AS p_D_tested_given_A_R,
  round(c / (c + d), 6) AS p_D_tested_given_A_S, n_trigger_tested, n_A_R, n_A_S, round(q_value, 6) AS q_value,
  q_value <= 0.05 AS significant, round(abs(ln(ratio)), 6) AS abs_log_or
FROM bh"""
)


def pair_screen(spark, sf):
    out = pairs.screen(_flagged(spark, sf))
    floats = [c for c, t in out.dtypes if t == "double"]
    return rounded(out, **{c: 6 for c in floats})


def pair_screen_top(spark, sf):
    out = pairs.screen(_flagged(spark, sf), top_n=20)
    return rounded(out.select("trigger", "target", "p_value", "q_value", "abs_log_or"), p_value=6, q_value=6, abs_log_or=6)


SCREEN_TOP_SQL = (
    "SELECT trigger, target, p_value, q_value, abs_log_or FROM ("
    + SCREEN_SQL.replace("SELECT trigger, target, round(ratio, 6)", "SELECT abs(ln(ratio)) AS raw_log, trigger, target, round(ratio, 6)", 1)
    + ") z ORDER BY significant DESC, raw_log DESC, trigger, target LIMIT 20"
)


def pair_counts(spark, sf):
    return pairs.pair_tables(_flagged(spark, sf), codes=warehouse.CODES)


def co_testing(spark, sf):
    return pairs.co_test_counts(_flagged(spark, sf))


CO_TEST_SQL = (
    base.with_(base.TESTS, base.FLAGS)
    + """SELECT x.code AS trigger, y.code AS target, CAST(sum(x.r) AS BIGINT) AS a, CAST(sum(1 - x.r) AS BIGINT) AS c
FROM flags x JOIN flags y ON x.isolate_id = y.isolate_id GROUP BY x.code, y.code"""
)


def pair_odds_ratios(spark, sf):
    t = pairs.association(pairs.gate(pairs.pair_tables(_flagged(spark, sf))))
    return rounded(
        t.select("trigger", "target", "or_unadjusted", "or_ci_low", "or_ci_high", "delta", "abs_log_or"),
        or_unadjusted=6, or_ci_low=6, or_ci_high=6, delta=6, abs_log_or=6,
    )


OR_SQL = (
    base.with_(base.TESTS, base.FLAGS, PAIR_CTES)
    + f"""SELECT trigger, target, round(ratio, 6) AS or_unadjusted, round(exp(ln(ratio) - 1.96 * se_log), 6) AS or_ci_low,
  round(exp(ln(ratio) + 1.96 * se_log), 6) AS or_ci_high, round(a / (a + b) - c / (c + d), 6) AS delta,
  round(abs(ln(ratio)), 6) AS abs_log_or
FROM (SELECT *, {OR_COLS} FROM tab WHERE n_trigger_tested >= 100 AND n_A_R >= 50 AND n_A_S >= 50 AND a + c > 0)"""
)


def fisher_exact(spark, sf):
    t = pairs.exact_test(pairs.gate(pairs.pair_tables(_flagged(spark, sf))))
    return rounded(t.select("trigger", "target", "a", "b", "c", "d", "p_value"), p_value=6)


FISHER_SQL = (
    base.with_(base.TESTS, base.FLAGS, PAIR_CTES, FISHER_CTES)
    + "SELECT trigger, target, a, b, c, d, round(p_value, 6) AS p_value FROM gated JOIN fisher USING (trigger, target) WHERE a + c > 0"
)


def benjamini_hochberg(spark, sf):
    """Per trigger family: normal-approximation p of the log odds ratio, then q-values."""
    t = pairs.association(pairs.gate(pairs.pair_tables(_flagged(spark, sf))))
    se = (F.ln("or_ci_high") - F.ln("or_ci_low")) / 3.92
    t = t.withColumn("p_value", stats.two_sided_p(F.ln("or_unadjusted") / se))
    out = pairs.benjamini_hochberg(t, ["trigger"]).select("trigger", "target", "p_value", "q_value", "significant")
    return rounded(out, p_value=6, q_value=6)


BH_SQL = (
    base.with_(base.TESTS, base.FLAGS, PAIR_CTES)
    + f""", z AS (SELECT trigger, target, ln(ratio) / se_log AS z FROM (
  SELECT *, {OR_COLS} FROM tab WHERE n_trigger_tested >= 100 AND n_A_R >= 50 AND n_A_S >= 50 AND a + c > 0)),
p AS (SELECT trigger, target, 2 * ({base.tail('z')}) AS p FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY p) AS rk, count(*) OVER (PARTITION BY trigger) AS m FROM p),
q AS (SELECT *, least(1.0, min(p * m / rk) OVER (PARTITION BY trigger ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
SELECT trigger, target, round(p, 6) AS p_value, round(q, 6) AS q_value, q <= 0.05 AS significant FROM q"""
)


def directional_screen(spark, sf):
    out = pairs.directional_screen(warehouse.panels(spark, sf), target="Brand#7", min_group=50)
    return rounded(out, delta=6, p_D_tested_given_A_R=6, p_D_tested_given_A_S=6)


DIRECTIONAL_SQL = (
    base.with_(base.TESTS)
    + """, g AS (
  SELECT code AS A, CAST(count(*) FILTER (outcome = 'R') AS BIGINT) AS n_A_R, CAST(count(*) FILTER (outcome = 'S') AS BIGINT) AS n_A_S,
    avg(d) FILTER (outcome = 'R') AS pr, avg(d) FILTER (outcome = 'S') AS ps
  FROM (SELECT t.*, CASE WHEN isolate_id IN (SELECT isolate_id FROM tests WHERE code = 'Brand#7') THEN 1 ELSE 0 END AS d
        FROM tests t WHERE code <> 'Brand#7') GROUP BY code)
SELECT A, 'Brand#7' AS target_D, round(pr - ps, 6) AS delta, round(pr, 6) AS p_D_tested_given_A_R,
  round(ps, 6) AS p_D_tested_given_A_S, n_A_R, n_A_S FROM g WHERE n_A_R >= 50 AND n_A_S >= 50"""
)


def implied_panel(spark, sf):
    out = pairs.implied_panel(_flagged(spark, sf), threshold=0.155, min_count=200, max_global_rate=0.155)
    sets = pairs.implied_panel_sets(out)
    return sets.select("code", F.array_join("implied", ",").alias("implied"), F.size("implied").alias("n_implied"))


IMPLIED_SQL = (
    base.with_(base.TESTS)
    + """, n AS (SELECT code, count(*) AS n FROM tests GROUP BY code),
tot AS (SELECT count(DISTINCT isolate_id) AS n FROM tests),
j AS (SELECT x.code, y.code AS implied, count(*) AS nj FROM tests x JOIN tests y ON x.isolate_id = y.isolate_id AND x.code <> y.code GROUP BY 1, 2)
SELECT j.code, string_agg(implied, ',' ORDER BY implied) AS implied, CAST(count(*) AS INTEGER) AS n_implied
FROM j JOIN n ON n.code = j.code JOIN n m ON m.code = j.implied, tot
WHERE n.n >= 200 AND nj / n.n >= 0.155 AND m.n / tot.n < 0.155 GROUP BY j.code"""
)

QUERIES = {
    "pair_screen": (pair_screen, SCREEN_SQL),
    "pair_screen_top20": (pair_screen_top, SCREEN_TOP_SQL),
    "pair_counts_2x2": (pair_counts, base.with_(base.TESTS, base.FLAGS, PAIR_CTES) + "SELECT trigger, target, a, b, c, d, n_trigger_tested, n_A_R, n_A_S FROM tab"),
    "co_testing_counts": (co_testing, CO_TEST_SQL),
    "pair_odds_ratios": (pair_odds_ratios, OR_SQL),
    "pair_fisher_exact": (fisher_exact, FISHER_SQL),
    "pair_benjamini_hochberg": (benjamini_hochberg, BH_SQL),
    "directional_screen": (directional_screen, DIRECTIONAL_SQL),
    "implied_panel": (implied_panel, IMPLIED_SQL),
}
