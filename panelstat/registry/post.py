"""Post-estimation and drug-dimension queries.

The result table is derived from the pair tables: the effect is the crude risk difference with its
normal standard error, so every oracle stays a plain aggregate query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import stats
from panelstat.operators import drugdims, pairs, panel, post
from panelstat.registry import base
from panelstat.registry.pairs import OR_COLS, PAIR_CTES, rounded
from panelstat.sources import warehouse


def _round_all(df, digits=6):
    return rounded(df, **{c: digits for c, t in df.dtypes if t == "double"})


def _results(spark, sf, min_group=50):
    """One row per pair: effect, se, interval, p, status."""
    flagged = panel.with_flags(warehouse.panels(spark, sf), drop_i=True)
    t = pairs.association(pairs.gate(pairs.pair_tables(flagged), 1, 1))
    p1, p0 = F.col("p_D_tested_given_A_R"), F.col("p_D_tested_given_A_S")
    se = F.sqrt(p1 * (1 - p1) / F.col("n_A_R") + p0 * (1 - p0) / F.col("n_A_S"))
    ok = (F.col("n_A_R") >= min_group) & (F.col("n_A_S") >= min_group)
    return t.select(
        "trigger", "target", F.col("delta").alias("rd"), se.alias("se"), "or_unadjusted", F.col("n_trigger_tested").alias("n_used"),
        (F.col("delta") - 1.96 * se).alias("ci_low"), (F.col("delta") + 1.96 * se).alias("ci_high"),
        F.when(se > 0, stats.two_sided_p(F.col("delta") / se)).otherwise(1.0).alias("p_value"),
        (F.col("n_A_R") * 1.0).alias("ess"), F.when(ok, "ok").otherwise("failed").alias("status"),
    )


def res_ctes(name: str = "res", min_group: int = 50) -> str:
    return f"""{name}0 AS (
  SELECT trigger, target, a / (a + b) AS p1, c / (c + d) AS p0, {OR_COLS}, n_trigger_tested AS n_used, n_A_R, n_A_S FROM tab WHERE n_A_R >= 1 AND n_A_S >= 1 AND a + c > 0),
{name}1 AS (SELECT *, p1 - p0 AS rd, sqrt(p1 * (1 - p1) / n_A_R + p0 * (1 - p0) / n_A_S) AS se FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN se > 0 THEN rd / se ELSE 0 END AS z FROM {name}1),
{name} AS (SELECT trigger, target, rd, se, ratio AS or_unadjusted, n_used, rd - 1.96 * se AS ci_low, rd + 1.96 * se AS ci_high,
  2 * ({base.tail('z')}) AS p_value, n_A_R * 1.0::DOUBLE AS ess, CASE WHEN n_A_R >= {min_group} AND n_A_S >= {min_group} THEN 'ok' ELSE 'failed' END AS status FROM {name}2)"""


RES = base.with_(base.TESTS, base.FLAGS, PAIR_CTES, res_ctes())


def _dof():
    return F.col("n_used") - 2



def sensitivity(spark, sf):
    out = post.robustness(post.ok_rows(_results(spark, sf)), _dof())
    return _round_all(out.select("trigger", "target", "rd", "se", "t_value", "partial_r2", "rv_q", "rv_alpha"))


def t_quantile_sql(p: float, dof: str) -> str:
    z = stats.normal_quantile(p)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return f"({z!r}::DOUBLE + " + " + ".join(f"{c!r}::DOUBLE / pow({dof}, {i + 1})" for i, c in enumerate(g)) + ")"


SENS_SQL = RES[:-1] + f""", s AS (SELECT *, rd / se AS t, CAST(n_used - 2 AS DOUBLE) AS dof, {t_quantile_sql(0.975, 'CAST(n_used - 2 AS DOUBLE)')} AS tc FROM res WHERE status = 'ok')
SELECT trigger, target, round(rd, 6) AS rd, round(se, 6) AS se, round(t, 6) AS t_value, round(t * t / (t * t + dof), 6) AS partial_r2,
  round(abs(t) / sqrt(t * t + dof), 6) AS rv_q, round(sqrt(tc * tc / (tc * tc + dof)), 6) AS rv_alpha FROM s"""


def sensitivity_contour(spark, sf):
    top = post.strongest_pair(_results(spark, sf))
    out = post.contour(top, _dof())
    return _round_all(out.select("trigger", "target", "r2_y_z", "r2_d_z", "estimate_adj", "t_adj", "p_value"))


TOP = "top1 AS (SELECT *, rd / se AS t, CAST(n_used - 2 AS DOUBLE) AS dof FROM res WHERE status = 'ok' ORDER BY abs(rd) DESC, trigger, target LIMIT 1)"
CONTOUR_SQL = RES[:-1] + f""", {TOP},
g AS (SELECT x / 49.0::DOUBLE AS r FROM unnest(generate_series(0, 49)) u(x)),
k AS (SELECT trigger, target, y.r AS r2_y_z, d.r AS r2_d_z, rd * greatest(0, 1 - y.r * d.r / (t * t / (t * t + dof))) AS est, se * sqrt(1 - y.r) AS sa, dof FROM top1, g y, g d),
l AS (SELECT *, CASE WHEN sa = 0 THEN CASE WHEN est > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE est / sa END AS t_adj FROM k),
m AS (SELECT *, CASE WHEN isinf(t_adj) THEN 0 ELSE (8 * dof + 1) / (8 * dof + 3) * sqrt(dof * ln(1 + t_adj * t_adj / dof)) END AS z FROM l)
SELECT trigger, target, round(r2_y_z, 6) AS r2_y_z, round(r2_d_z, 6) AS r2_d_z, round(est, 6) AS estimate_adj, CASE WHEN isinf(t_adj) THEN t_adj ELSE round(t_adj, 6) END AS t_adj,
  CASE WHEN isinf(t_adj) THEN 0.0 ELSE round(2 * ({base.tail('z')}), 6) END AS p_value FROM m"""


def strongest_pair(spark, sf):
    return _round_all(post.strongest_pair(_results(spark, sf)).select("trigger", "target", "rd", "se", "status"))


def shrinkage(spark, sf):
    return _round_all(post.shrink(_results(spark, sf), scale=0.1, points=200))


TAU_VALUES = ", ".join(f"({t!r}::DOUBLE, {lp!r}::DOUBLE)" for t, lp in post.tau_grid("halfcauchy", 0.1, 200))
SHRINK_SQL = RES[:-1] + f""", dat AS (SELECT * FROM res WHERE status = 'ok' AND se > 0),
tau AS (SELECT * FROM (VALUES {TAU_VALUES}) v(tau, lp)),
ll AS (SELECT tau, sum(-ln(se * se + tau * tau) / 2 - rd * rd / (se * se + tau * tau) / 2) + max(lp) AS lw FROM dat, tau GROUP BY tau),
wt AS (SELECT tau, exp(lw - max(lw) OVER ()) / sum(exp(lw - (SELECT max(lw) FROM ll))) OVER () AS w FROM ll),
ps AS (SELECT trigger, target, rd, se, w, rd * tau * tau / (tau * tau + se * se) AS m, tau * tau * se * se / (tau * tau + se * se) AS v FROM dat, wt),
pz AS (SELECT *, m / sqrt(v) AS z FROM ps),
pp AS (SELECT trigger, target, rd, se, sum(w * m) AS th, sum(w * (v + m * m)) AS m2,
  sum(w * (CASE WHEN z > 0 THEN 1 - ({base.tail('z')}) ELSE {base.tail('z')} END)) AS pos, rd / se AS zr FROM pz GROUP BY trigger, target, rd, se)
SELECT trigger, target, round(rd, 6) AS rd, round(se, 6) AS se, round(th, 6) AS theta_shrunken, round(sqrt(greatest(m2 - th * th, 0)), 6) AS theta_sd,
  round(pos, 6) AS prob_positive, round(2 * ({base.tail('zr')}), 6) AS p_value FROM pp"""


def posterior_ranking(spark, sf):
    out = post.posterior_ranking(_round_all(post.shrink(_results(spark, sf), scale=0.1, points=200)), 0.9)
    return out.select("rank", "trigger", "target", "highlight")


RANK_SQL = "SELECT CAST(row_number() OVER (ORDER BY prob_positive DESC, trigger, target) AS INTEGER) AS rank, trigger, target, prob_positive >= 0.9 AS highlight FROM (" + SHRINK_SQL + ") q"


def export_table(spark, sf):
    kept = post.export_filter(_results(spark, sf), p_threshold=0.1, rd_min=0.01, direction="both", min_ess=600)
    return _round_all(kept.select("trigger", "target", "rd", "p_value", "ess"))


EXPORT_WHERE = "FROM res WHERE status = 'ok' AND p_value < 0.1 AND abs(rd) >= 0.01 AND ess >= 600"
EXPORT_SQL = RES + "SELECT trigger, target, round(rd, 6) AS rd, round(p_value, 6) AS p_value, ess " + EXPORT_WHERE


def dependency_map(spark, sf):
    kept = post.export_filter(_results(spark, sf), p_threshold=0.2, direction="positive")
    deps = post.dependencies(kept).select("target", F.array_join("triggers", ",").alias("triggers"))
    effects = post.effect_map(kept).select("target", F.size("effects").alias("n_effects"), F.round(F.array_max(F.map_values("effects")), 6).alias("max_effect"))
    return deps.join(effects, "target")


DEPS_SQL = RES + """SELECT target, string_agg(trigger, ',' ORDER BY trigger) AS triggers, CAST(count(*) AS INTEGER) AS n_effects, round(max(rd), 6) AS max_effect
FROM res WHERE status = 'ok' AND p_value < 0.2 AND rd > 0 GROUP BY target"""


def effect_summary(spark, sf):
    return _round_all(post.summary_statistics(post.export_filter(_results(spark, sf), p_threshold=None, direction="both")))


SUMMARY_SQL = RES + """SELECT count(*) AS n_pairs, round(avg(rd), 6) AS avg_rd, round(stddev_samp(rd), 6) AS std_rd, round(min(rd), 6) AS min_rd,
  round(max(rd), 6) AS max_rd, round(median(rd), 6) AS median_rd FROM res WHERE status = 'ok'"""


def effect_edges(spark, sf):
    return _round_all(post.edges(_results(spark, sf), 0.05, 0.005))


EDGES_SQL = RES + "SELECT trigger, target, round(rd, 6) AS effect, round(abs(rd), 6) AS weight, CAST(sign(rd) AS INTEGER) AS sign FROM res WHERE p_value < 0.05 AND abs(rd) >= 0.005"


def screen_vs_effects(spark, sf):
    r = _results(spark, sf)
    return _round_all(post.trend_line(post.screen_with_effects(r.select("trigger", "target", "or_unadjusted"), r), "or_unadjusted", "rd"))


TREND_SQL = RES + """SELECT round(regr_slope(rd, or_unadjusted), 6) AS slope, round(regr_intercept(rd, or_unadjusted), 6) AS intercept, round(regr_r2(rd, or_unadjusted), 6) AS r2,
  round(corr(or_unadjusted, rd), 6) AS corr, CAST(regr_count(rd, or_unadjusted) AS BIGINT) AS n FROM res"""


def run_comparison(spark, sf):
    """The same pairs with resistance as R only and as R or I."""
    flagged = panel.with_flags(warehouse.panels(spark, sf), recode_mode="NS_vs_S")
    t = pairs.association(pairs.gate(pairs.pair_tables(flagged), 1, 1))
    other = t.select("trigger", "target", F.col("delta").alias("rd"), F.col("or_ci_low").alias("ci_low"), F.col("or_ci_high").alias("ci_high"))
    return _round_all(post.compare_runs(_results(spark, sf), other))


NS = PAIR_CTES.replace("margin", "hmargin").replace("joint", "hjoint").replace("tab AS", "htab AS").replace("flags", "hflags")
COMPARE_SQL = RES[:-1] + f""", hflags AS (SELECT isolate_id, code, CASE WHEN outcome IN ('R', 'I') THEN 1 ELSE 0 END AS r FROM tests), {NS},
h AS (SELECT trigger, target, a / (a + b) - c / (c + d) AS rd, exp(ln(ratio) - 1.96 * se_log) AS lo, exp(ln(ratio) + 1.96 * se_log) AS hi FROM (SELECT *, {OR_COLS} FROM htab WHERE a + c > 0 AND n_A_R >= 1 AND n_A_S >= 1))
SELECT r.trigger, r.target, round(r.rd, 6) AS rd_false, round(r.ci_low, 6) AS ci_low_false, round(r.ci_high, 6) AS ci_high_false, round(h.rd, 6) AS rd_true,
  round(h.lo, 6) AS ci_low_true, round(h.hi, 6) AS ci_high_true, round(h.rd - r.rd, 6) AS rd_diff, r.trigger || ' → ' || r.target AS pair
FROM res r JOIN h ON r.trigger = h.trigger AND r.target = h.target WHERE r.status = 'ok'"""


def effect_matrix(spark, sf):
    out = post.effect_matrix(_results(spark, sf), warehouse.CODES)
    return _round_all(out.withColumnsRenamed({c: c.replace("#", "") for c in out.columns}))


MATRIX_SQL = RES + "SELECT trigger, " + ", ".join(
    f"round(coalesce(max(rd) FILTER (target = '{c}'), 0), 6) AS {c.replace('#', '')}" for c in warehouse.CODES
) + " FROM res GROUP BY trigger"


def forest_table(spark, sf):
    return _round_all(post.forest_order(_results(spark, sf)).select("position", "pair", "rd", "ci_low", "ci_high"))


FOREST_SQL = RES + """SELECT CAST(row_number() OVER (ORDER BY rd, trigger, target) AS INTEGER) AS position, trigger || ' → ' || target AS pair, round(rd, 6) AS rd,
  round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM res WHERE status = 'ok'"""


def time_trend(spark, sf):
    """Yearly resistance share of each drug with its normal band."""
    long = panel.long_tests(warehouse.isolates(spark, sf), ["year"])
    r = (F.col("outcome") == "R").cast("double")
    agg = long.groupBy("code", "year").agg(F.avg(r).alias("rd"), F.count(F.lit(1)).alias("n"))
    agg = agg.withColumn("se", F.sqrt(F.col("rd") * (1 - F.col("rd")) / F.col("n")))
    return _round_all(post.time_trend(agg, "year", ["code"]))


TIME_SQL = base.with_(base.TESTS, base.META) + """SELECT code, year, round(p, 6) AS rd, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS band_low, round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS band_high
FROM (SELECT code, year, avg(CASE WHEN outcome = 'R' THEN 1.0 ELSE 0 END)::DOUBLE AS p, count(*) AS n FROM tests JOIN meta USING (isolate_id) GROUP BY 1, 2)"""


def _isolate_effects(spark, sf):
    """A per-isolate effect: the resistant share of its panel."""
    df = warehouse.isolates(spark, sf)
    n_r = F.size(F.filter("tests", lambda t: t["outcome"] == "R"))
    return df.select("ward", "care_type", (n_r / panel.panel_depth()).alias("cate"))


EFF = base.with_(
    base.TESTS, base.META,
    "eff AS (SELECT ward, care_type, r AS cate FROM meta JOIN (SELECT isolate_id, avg(CASE WHEN outcome = 'R' THEN 1.0 ELSE 0 END)::DOUBLE AS r FROM tests GROUP BY 1) USING (isolate_id))",
)


def cate_summary(spark, sf):
    df = _isolate_effects(spark, sf)
    return _round_all(post.effect_summary(df, "cate", "ward").unionByName(post.effect_summary(df, "cate")))


CATE_SQL = EFF + """SELECT ward AS "group", round(avg(cate), 6) AS mean_cate, round(stddev_samp(cate), 6) AS std_cate, count(*) AS "count" FROM eff GROUP BY ward
UNION ALL SELECT 'all', round(avg(cate), 6), round(stddev_pop(cate), 6), count(*) FROM eff"""


def subgroup_effects(spark, sf):
    return _round_all(post.subgroup_effects(_isolate_effects(spark, sf), "cate", "care_type"))


Z95 = repr(stats.normal_quantile(0.975))
SUBGROUP_SQL = EFF + f"""SELECT care_type AS subgroup, round(avg(cate), 6) AS ate, round(avg(cate) - {Z95} * stddev_samp(cate) / sqrt(count(*)), 6) AS ci_low,
  round(avg(cate) + {Z95} * stddev_samp(cate) / sqrt(count(*)), 6) AS ci_high, count(*) AS n FROM eff GROUP BY care_type"""


def subgroup_differences(spark, sf):
    return _round_all(post.subgroup_differences(_isolate_effects(spark, sf), "cate", "ward", "3-MEDIUM"))


DIFF_SQL = EFF[:-1] + f""", g AS (SELECT ward, avg(cate) AS m, var_samp(cate) AS v, count(*) AS n FROM eff GROUP BY ward),
x AS (SELECT a.ward, a.m - r.m AS diff, sqrt(a.v / a.n + r.v / r.n) AS se FROM g a, g r WHERE r.ward = '3-MEDIUM' AND a.ward <> '3-MEDIUM'),
y AS (SELECT *, diff / se AS z FROM x)
SELECT ward AS subgroup, round(diff, 6) AS diff, round(diff - {Z95} * se, 6) AS ci_low, round(diff + {Z95} * se, 6) AS ci_high, round(2 * ({base.tail('z')}), 6) AS p_value FROM y"""


def cate_histogram(spark, sf):
    df = _isolate_effects(spark, sf)
    return _round_all(post.effect_histogram(df, "cate", 16))


HIST_SQL = EFF + """SELECT bin, round(bin / 16.0, 6)::DOUBLE AS low, round((bin + 1) / 16.0, 6)::DOUBLE AS high, count(*) AS n
FROM (SELECT CAST(least(floor(cate * 16), 15) AS INTEGER) AS bin FROM eff) GROUP BY bin"""


def _weights(spark, sf):
    return warehouse.table(spark, sf, "lineitem").select("l_returnflag", (1 / (F.col("l_discount") + 0.01)).alias("w"))


def weight_summary(spark, sf):
    return _round_all(post.weight_summary(_weights(spark, sf), "w", ["l_returnflag"]))


WSUM_SQL = "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(w, {q}), 6) AS q{int(q * 100):02d}" for q in (0, 0.01, 0.5, 0.99, 1)) + """,
  round(sum(w) * sum(w) / sum(w * w), 6) AS ess, count(*) AS n FROM (SELECT l_returnflag, 1 / (l_discount + 0.01) AS w FROM lineitem) GROUP BY 1"""


def weight_trimming(spark, sf):
    price = warehouse.table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("w"))
    trimmed, report = post.trim_weights(price, "w", 1, 99)
    total = trimmed.agg(F.sum("trimmed")).scalar()
    return _round_all(report.withColumn("trimmed_sum", F.round(total, 3)))


TRIM_SQL = """SELECT round(min(w), 6) AS original_min, round(max(w), 6) AS original_max, round(max(lo), 6) AS trim_lower, round(max(hi), 6) AS trim_upper,
  count(*) FILTER (w < lo) AS n_trimmed_lower, count(*) FILTER (w > hi) AS n_trimmed_upper, round(round(sum(least(greatest(w, lo), hi)), 3), 6) AS trimmed_sum
FROM (SELECT l_extendedprice / 1000 AS w FROM lineitem), (SELECT quantile_cont(l_extendedprice / 1000, 0.01) AS lo, quantile_cont(l_extendedprice / 1000, 0.99) AS hi FROM lineitem)"""


# ---- drug dimension ------------------------------------------------------------------------------


def _drug_list(spark, sf):
    """Local drug list: part names in three spellings; reference list: part names that contain "widget" or "ring"."""
    parts = warehouse.table(spark, sf, "part")
    k = F.col("p_partkey") % 3
    local = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("Class"), F.col("p_brand").alias("brand"),
        F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit("_oral"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("Antibiotic Name"),
    )
    reference = (
        parts.filter(F.col("p_name").contains("widget") | F.col("p_name").contains("ring"))
        .groupBy(F.col("p_name").alias("Antibiotic")).agg(F.min("p_type").alias("Category"))
    )
    synonyms = spark.createDataFrame([("smallbolt", "small ring"), ("redbolt", "red widget"), ("bluebolt", "no such drug")], "alias string, name string")
    return local, reference, synonyms


def drug_matching(spark, sf):
    """Exact and synonym tiers (the approximate tier is left to its own query)."""
    local, reference, synonyms = _drug_list(spark, sf)
    out = drugdims.match_drugs(local, reference, synonyms, ref_columns=["Category"], threshold=1.1)
    return out.select("id", "WHO_Match", "Match_Type", "Category", F.col("Broad Class").alias("broad_class"))


MATCH_SQL = """WITH ref AS (SELECT p_name AS name, replace(p_name, ' ', '') AS norm, min(p_type) AS cat FROM part WHERE contains(p_name, 'widget') OR contains(p_name, 'ring') GROUP BY 1, 2),
l AS (SELECT p_partkey AS id, p_type, replace(p_name, ' ', '') AS norm FROM part),
m AS (SELECT l.*, coalesce(r.name, s.name) AS hit FROM l LEFT JOIN ref r ON r.norm = l.norm
  LEFT JOIN (SELECT v.alias, ref.name FROM (VALUES ('smallbolt', 'smallring'), ('redbolt', 'redwidget')) v(alias, norm) JOIN ref ON ref.norm = v.norm) s ON s.alias = l.norm)
SELECT id, coalesce(hit, 'NO MATCH') AS "WHO_Match", CASE WHEN hit IS NULL THEN 'UNMATCHED' ELSE 'PERFECT' END AS "Match_Type", coalesce(cat, 'Not Set') AS "Category", p_type AS broad_class
FROM m LEFT JOIN ref ON ref.name = m.hit"""


def drug_matching_fuzzy(spark, sf):
    local, reference, synonyms = _drug_list(spark, sf)
    out = drugdims.match_drugs(local, reference, synonyms, ref_columns=["Category"], threshold=0.7)
    return out.groupBy("Antibiotic Name", "WHO_Match", "Match_Type").agg(F.count(F.lit(1)).alias("n"))


def drug_match_report(spark, sf):
    local, reference, synonyms = _drug_list(spark, sf)
    return drugdims.match_report(drugdims.match_drugs(local, reference, synonyms, ref_columns=["Category"], threshold=1.1))


REPORT_SQL = f"""SELECT "Match_Type" AS kind, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM ({MATCH_SQL}) GROUP BY 1"""


def drug_unmatched_reference(spark, sf):
    """Reference names no part of type PROMO and Brand#1 is matched to."""
    local, reference, synonyms = _drug_list(spark, sf)
    matched = drugdims.match_drugs(local.filter(F.col("Class") == "PROMO").filter(F.col("brand") == "Brand#1"), reference, synonyms, ref_columns=["Category"], threshold=1.1)
    return drugdims.unmatched_reference(matched, reference)


UNREF_SQL = """SELECT DISTINCT p_name AS "Antibiotic" FROM part WHERE (contains(p_name, 'widget') OR contains(p_name, 'ring'))
  AND p_name NOT IN (SELECT p_name FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#1')
  AND NOT (p_name = 'small ring' AND EXISTS (SELECT 1 FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#1' AND p_name = 'small bolt'))
  AND NOT (p_name = 'red widget' AND EXISTS (SELECT 1 FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#1' AND p_name = 'red bolt'))"""


def class_membership(spark, sf):
    """Drug columns per part type, for drugs that carry a resistant result somewhere."""
    dim = warehouse.table(spark, sf, "part").select(F.col("p_type").alias("Class"), F.col("p_brand").alias("Full Name")).distinct()
    tests = panel.long_tests(warehouse.panels(spark, sf), [])
    present = tests.groupBy("code").agg(F.count_if(F.col("outcome") == "R").alias("n")).filter(F.col("n") % 2 == 0).select(F.col("code").alias("name"))
    out = drugdims.class_map(dim, present, "Class", ["PROMO", "SMALL", "LARGE", "unknown"])
    return out.select("class", F.array_join("columns", ",").alias("columns"))


CLASS_SQL = base.with_(base.TESTS) + """SELECT p_type AS class, string_agg(DISTINCT p_brand || '_Tested', ',' ORDER BY p_brand || '_Tested') AS columns FROM part
WHERE p_type IN ('PROMO', 'SMALL', 'LARGE') AND p_brand IN (SELECT code FROM tests GROUP BY code HAVING count(*) FILTER (outcome = 'R') % 2 = 0) GROUP BY 1"""


QUERIES = {
    "sensitivity": (sensitivity, SENS_SQL),
    "sensitivity_contour": (sensitivity_contour, CONTOUR_SQL),
    "strongest_pair": (strongest_pair, RES[:-1] + f", {TOP} SELECT trigger, target, round(rd, 6) AS rd, round(se, 6) AS se, status FROM top1"),
    "shrinkage": (shrinkage, SHRINK_SQL),
    "posterior_ranking": (posterior_ranking, RANK_SQL),
    "export_filter": (export_table, EXPORT_SQL),
    "dependency_map": (dependency_map, DEPS_SQL),
    "effect_summary": (effect_summary, SUMMARY_SQL),
    "effect_edges": (effect_edges, EDGES_SQL),
    "screen_vs_effect_trend": (screen_vs_effects, TREND_SQL),
    "run_comparison": (run_comparison, COMPARE_SQL),
    "effect_matrix": (effect_matrix, MATRIX_SQL),
    "forest_table": (forest_table, FOREST_SQL),
    "time_trend": (time_trend, TIME_SQL),
    "cate_summary": (cate_summary, CATE_SQL),
    "subgroup_effects": (subgroup_effects, SUBGROUP_SQL),
    "subgroup_differences": (subgroup_differences, DIFF_SQL),
    "cate_histogram": (cate_histogram, HIST_SQL),
    "weight_summary": (weight_summary, WSUM_SQL),
    "weight_trimming": (weight_trimming, TRIM_SQL),
    "drug_matching": (drug_matching, MATCH_SQL),
    "drug_matching_fuzzy": (drug_matching_fuzzy, None),
    "drug_match_report": (drug_match_report, REPORT_SQL),
    "drug_unmatched_reference": (drug_unmatched_reference, UNREF_SQL),
    "class_membership": (class_membership, CLASS_SQL),
}
