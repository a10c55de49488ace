"""Cohort profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat import session
from panelstat.operators import panel, profile
from panelstat.registry import base
from panelstat.registry.pairs import rounded
from panelstat.sources import warehouse


def _cohort(spark, sf):
    return warehouse.isolates(spark, sf).filter(F.col("year").between(1996, 2000))


COHORT = base.with_(
    base.TESTS, base.META, base.ISO,
    "c AS (SELECT * FROM iso WHERE year BETWEEN 1996 AND 2000)",
    "ct AS (SELECT t.*, c.year, c.lab, c.ward FROM tests t JOIN c USING (isolate_id))",
)


def value_shares(spark, sf):
    return profile.value_shares(
        _cohort(spark, sf), ["year", "ward", "care_type", "pathogen_group", "age_group", "sex", "excl_negative"], keep_null=["age_group", "sex"]
    )


SHARES_SQL = COHORT + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM c), 1)::DOUBLE AS pct FROM c "
    + ("" if d in ("age_group", "sex") else f"WHERE {d} IS NOT NULL ")
    + f"GROUP BY {d}"
    for d in ["year", "ward", "care_type", "pathogen_group", "age_group", "sex", "excl_negative"]
)


def testing_frequency(spark, sf):
    return profile.testing_frequency(_cohort(spark, sf), top_n=20)


TESTFREQ_SQL = COHORT + """SELECT code, n_tested, pct_tested FROM (
  SELECT code, count(*) AS n_tested, round_even(count(*) * 100.0 / (SELECT count(*) FROM c), 1)::DOUBLE AS pct_tested FROM ct GROUP BY code)
ORDER BY pct_tested DESC, n_tested DESC, code LIMIT 20"""


def resistance_table(spark, sf):
    return profile.resistance_table(_cohort(spark, sf), top_n=15, sort_by="pct_r")


RIS = """count(*) AS n_tested, count(*) FILTER (outcome = 'R') AS n_r, count(*) FILTER (outcome = 'I') AS n_i, count(*) FILTER (outcome = 'S') AS n_s,
  round_even(count(*) FILTER (outcome = 'R') * 100.0 / count(*), 1)::DOUBLE AS pct_r,
  round_even(count(*) FILTER (outcome IN ('R', 'I')) * 100.0 / count(*), 1)::DOUBLE AS pct_ns"""
RIS_ALL = RIS + """, round_even(count(*) FILTER (outcome = 'I') * 100.0 / count(*), 1)::DOUBLE AS pct_i,
  round_even(count(*) FILTER (outcome = 'S') * 100.0 / count(*), 1)::DOUBLE AS pct_s"""
RESISTANCE_SQL = COHORT + f"SELECT * FROM (SELECT code, {RIS} FROM ct GROUP BY code) ORDER BY pct_r DESC, n_tested DESC, code LIMIT 15"


def yearly_global_top(spark, sf):
    return profile.yearly_results(_cohort(spark, sf), top_n=8, sort_by="pct_ns", min_tested=5)


YEARLY = f", y AS (SELECT year, code, {RIS_ALL} FROM ct GROUP BY year, code HAVING count(*) >= 5)"
YEARLY_SQL = COHORT[:-1] + YEARLY + """, a AS (
  SELECT code, row_number() OVER (ORDER BY pns DESC, n DESC, code) AS ord FROM (
    SELECT code, sum(n_tested) AS n, round_even((sum(n_r) + sum(n_i)) * 100.0 / sum(n_tested), 1) AS pns FROM y GROUP BY code))
SELECT y.*, CAST(ord AS INTEGER) AS ord FROM y JOIN a USING (code) WHERE ord <= 8"""


def yearly_top_per_year(spark, sf):
    return profile.yearly_results(_cohort(spark, sf), top_n=3, selection="top_per_year", sort_by="pct_r", years=[1997, 1998])


PER_YEAR_SQL = COHORT[:-1] + f""", y AS (SELECT year, code, {RIS_ALL} FROM ct WHERE year IN (1997, 1998) GROUP BY year, code)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY pct_r DESC, n_tested DESC, code) AS INTEGER) AS ord FROM y) WHERE ord <= 3"""


def yearly_custom(spark, sf):
    return profile.yearly_results(_cohort(spark, sf), selection="custom", custom_codes=["Brand#9", "brand#2", "Brand#9"])


CUSTOM_SQL = COHORT[:-1] + f", y AS (SELECT year, code, {RIS_ALL} FROM ct GROUP BY year, code) SELECT *, CAST(CASE code WHEN 'Brand#9' THEN 1 ELSE 2 END AS INTEGER) AS ord FROM y WHERE code IN ('Brand#9', 'Brand#2')"


def prevalence(spark, sf):
    out = profile.prevalence(_cohort(spark, sf), "NS_vs_S")
    return rounded(out, tested_rate=6, res_rate_tested=6)


PREVALENCE_SQL = COHORT + """SELECT code, round(count(*) / (SELECT count(*) FROM c), 6) AS tested_rate, count(*) AS tested_count,
  round(count(*) FILTER (outcome IN ('R', 'I')) / count(*), 6) AS res_rate_tested, count(*) FILTER (outcome IN ('R', 'I')) AS res_count_tested FROM ct GROUP BY code"""


def cohort_metadata(spark, sf):
    df = _cohort(spark, sf)
    everything = profile.cohort_metadata(df, "all", {"year": [1996, 2000]})
    one = profile.cohort_metadata(df.filter(F.col("pathogen_group") == "ASIA"), "asia", {"group": "ASIA"})
    return everything.unionByName(one)


META_SQL = COHORT + f"""SELECT 'all' AS name, count(*) AS n_rows, count(DISTINCT lab) AS n_labs, min(year_month) AS yearmonth_min, max(year_month) AS yearmonth_max,
  CAST(NULL AS VARCHAR) AS pathogen, substr(sha256('{{"year": [1996, 2000]}}'), 1, 16) AS fingerprint FROM c
UNION ALL SELECT 'asia', count(*), count(DISTINCT lab), min(year_month), max(year_month), 'ASIA', substr(sha256('{{"group": "ASIA"}}'), 1, 16) FROM c WHERE pathogen_group = 'ASIA'"""


def _with_provided(spark, sf):
    """A provided depth that is the number of order lines (repeat drugs make it too large)."""
    df = warehouse.panels(spark, sf)
    lines = warehouse.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("isolate_id")).agg(F.count(F.lit(1)).alias("provided"))
    return df.join(lines, "isolate_id")


def depth_check(spark, sf):
    out = profile.depth_check(_with_provided(spark, sf), "provided", panel.panel_depth())
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double"})


DEPTH_CTES = base.with_(
    base.TESTS,
    """d AS (SELECT p.isolate_id, CAST(p.n AS INTEGER) AS p, CAST(c.n AS INTEGER) AS c
  FROM (SELECT l_orderkey AS isolate_id, count(*) AS n FROM lineitem GROUP BY 1) p JOIN (SELECT isolate_id, count(*) AS n FROM tests GROUP BY 1) c USING (isolate_id))""",
)
DEPTH_SQL = DEPTH_CTES + """SELECT count(*) AS n_rows, round(avg(p), 6) AS provided_mean, round(avg(c), 6) AS computed_mean, round(avg(abs(p - c)), 6) AS absdiff_mean,
  round(avg(CASE WHEN p = c THEN 100.0 ELSE 0 END), 6)::DOUBLE AS pct_exact_match, round(avg(CASE WHEN abs(p - c) >= 1 THEN 100.0 ELSE 0 END), 6)::DOUBLE AS pct_absdiff_ge_1,
  round(avg(CASE WHEN abs(p - c) >= 3 THEN 100.0 ELSE 0 END), 6)::DOUBLE AS pct_absdiff_ge_3 FROM d"""


def depth_differences(spark, sf):
    return profile.depth_differences(_with_provided(spark, sf), "provided", panel.panel_depth(), top_n=4)


DEPTH_DIFF_SQL = DEPTH_CTES + "SELECT p - c AS diff, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, diff LIMIT 4"


def lab_panel_depth(spark, sf):
    out = profile.depth_by_group(_cohort(spark, sf), "lab", panel.panel_depth())
    return rounded(out, depth_mean=6, depth_std=6, median=6)


LAB_SQL = COHORT + """SELECT lab, count(*) AS n_isolates, round(avg(n), 6) AS depth_mean, round(median(n), 6) AS median, CAST(min(n) AS DOUBLE) AS "min",
  CAST(max(n) AS DOUBLE) AS "max", round(stddev_samp(n), 6) AS depth_std
FROM (SELECT lab, isolate_id, count(*) AS n FROM ct GROUP BY 1, 2) GROUP BY lab"""


def tests_by_lab(spark, sf):
    return profile.tests_by_group(_cohort(spark, sf), "lab", top_n=10)


BY_LAB_SQL = COHORT + """SELECT x.lab, x.code, x.n, CAST(t.total_tests AS BIGINT) AS total_tests FROM (SELECT lab, code, count(*) AS n FROM ct GROUP BY 1, 2) x
JOIN (SELECT lab, count(*) AS total_tests FROM ct GROUP BY lab ORDER BY total_tests DESC, lab LIMIT 10) t ON t.lab = x.lab"""


def _items(spark, sf):
    df = session.checkpoint(_cohort(spark, sf).select("isolate_id", "tests", "ward", "care_type", "age_group", "year"))
    drugs = profile.select_drugs(
        profile.prevalence(df), min_test_rate=0.14, min_res_count=100, always_keep=["Brand#6"], max_drugs=12
    )
    return profile.transactions(
        df, "isolate_id", drugs, ["ward", "care_type", "age_group", "year"], min_count=50, max_levels=4, drop_all_susceptible=True
    )


def transaction_items(spark, sf):
    return profile.item_table(_items(spark, sf))


def transaction_baskets(spark, sf):
    out = profile.baskets(_items(spark, sf), "isolate_id")
    return out.select("isolate_id", F.array_join("items", ",").alias("items"))


def item_audit(spark, sf):
    """Drugs with resistant items whose tests were taken out of every tenth isolate."""
    lost = (F.col("isolate_id") % 10 == 3) & F.col("item").endswith("_T")
    return profile.resistant_without_test(_items(spark, sf).where(~lost), "isolate_id")


ITEM_CTES = """, prev AS (
  SELECT code, count(*) / (SELECT count(*) FROM c) AS tr, count(*) FILTER (outcome = 'R') AS rc, count(*) FILTER (outcome = 'R') / count(*) AS rr FROM ct GROUP BY code),
drugs AS (SELECT code FROM prev WHERE (tr >= 0.14 AND rc >= 100) OR code = 'Brand#6' ORDER BY tr DESC, rr DESC, code LIMIT 12),
kept AS (SELECT * FROM c WHERE isolate_id IN (SELECT isolate_id FROM ct WHERE outcome = 'R' AND code IN (SELECT code FROM drugs))),
cov AS (
  SELECT isolate_id, 'ward' AS k, coalesce(ward, 'NA') AS v FROM kept UNION ALL SELECT isolate_id, 'care_type', coalesce(care_type, 'NA') FROM kept
  UNION ALL SELECT isolate_id, 'age_group', coalesce(age_group, 'NA') FROM kept UNION ALL SELECT isolate_id, 'year', CAST(year AS VARCHAR) FROM kept),
lev AS (SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS rk, count(*) AS n FROM cov GROUP BY k, v HAVING count(*) >= 50) WHERE rk <= 4),
items AS (
  SELECT isolate_id, code || '_T' AS item FROM ct WHERE code IN (SELECT code FROM drugs) AND isolate_id IN (SELECT isolate_id FROM kept)
  UNION ALL SELECT isolate_id, code || '_R' FROM ct WHERE outcome = 'R' AND code IN (SELECT code FROM drugs) AND isolate_id IN (SELECT isolate_id FROM kept)
  UNION ALL SELECT isolate_id, cov.k || '=' || cov.v FROM cov JOIN lev ON cov.k = lev.k AND cov.v = lev.v)
"""
ITEMS_SQL = COHORT[:-1] + ITEM_CTES + "SELECT item, count(*) AS n FROM items GROUP BY item"
BASKETS_SQL = COHORT[:-1] + ITEM_CTES + "SELECT isolate_id, string_agg(item, ',' ORDER BY item) AS items FROM items GROUP BY isolate_id"
AUDIT_SQL = COHORT[:-1] + ITEM_CTES + """SELECT code, count(*) AS n FROM (
  SELECT isolate_id, left(item, length(item) - 2) AS code FROM items WHERE item LIKE '%\\_R' ESCAPE '\\'
  EXCEPT SELECT isolate_id, left(item, length(item) - 2) FROM items WHERE item LIKE '%\\_T' ESCAPE '\\' AND isolate_id % 10 <> 3) GROUP BY code"""

QUERIES = {
    "value_shares": (value_shares, SHARES_SQL),
    "testing_frequency": (testing_frequency, TESTFREQ_SQL),
    "resistance_table": (resistance_table, RESISTANCE_SQL),
    "yearly_global_top": (yearly_global_top, YEARLY_SQL),
    "yearly_top_per_year": (yearly_top_per_year, PER_YEAR_SQL),
    "yearly_custom": (yearly_custom, CUSTOM_SQL),
    "prevalence": (prevalence, PREVALENCE_SQL),
    "cohort_metadata": (cohort_metadata, META_SQL),
    "panel_depth_check": (depth_check, DEPTH_SQL),
    "panel_depth_differences": (depth_differences, DEPTH_DIFF_SQL),
    "lab_panel_depth": (lab_panel_depth, LAB_SQL),
    "tests_by_lab": (tests_by_lab, BY_LAB_SQL),
    "transaction_items": (transaction_items, ITEMS_SQL),
    "transaction_baskets": (transaction_baskets, BASKETS_SQL),
    "item_audit": (item_audit, AUDIT_SQL),
}
