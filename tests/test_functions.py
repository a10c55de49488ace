import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from panelstat.functions import calendar, stats, tokens


def values(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_result_tokens(spark):
    cases = {
        None: None, "": None, " ": None, "NA": None, ".": None, "-": None, "r": "R", "Res": "R", "S;": "S", "I.": "I",
        "R/S": "R", "s\\i": "I", "n/a": None, "1": "R", "0": "S", "susceptible": "S", "x": None, " i / s ": "I", "q/ s": "S",
        "\tR\n": "R",
    }
    got = values(spark, [(k,) for k in cases], "x string", y=tokens.result_token(F.col("x")))
    assert [g[0] for g in got] == list(cases.values())


def test_tested_flag(spark):
    cases = {"1": 1, "0": 0, "1.0": 1, "true": 1, "no": 0, "2": 1, "-1": 0, None: 0, "abc": 0, " Yes ": 1}
    got = values(spark, [(k,) for k in cases], "x string", y=tokens.tested_flag(F.col("x")))
    assert [g[0] for g in got] == list(cases.values())


def test_outcomes_and_booleans(spark):
    got = values(
        spark, [("s,",), (" r ",), ("I..",), ("ND",), ("RS",), (None,)], "x string",
        strict=tokens.outcome_token(F.col("x")), light=tokens.outcome_token_light(F.col("x")),
    )
    assert got == [("S", "S,"), ("R", "R"), ("I", "I.."), (None, "ND"), (None, "RS"), (None, "")]
    got = values(spark, [("2",), ("t",), ("0",), ("n",), ("maybe",), (None,)], "x string", a=tokens.truthy(F.col("x")), b=tokens.tri_state(F.col("x")))
    assert got == [(True, None), (True, True), (False, False), (False, False), (False, None), (False, None)]


def test_drop_i_keeps_only_r(spark):
    got = values(
        spark, [("R",), ("I",), ("S",), (None,)], "x string",
        a=tokens.resistant_mask(F.col("x"), "NS_vs_S"), b=tokens.resistant_mask(F.col("x"), "NS_vs_S", True),
    )
    assert got == [(True, True), (True, False), (False, False), (False, False)]
    with pytest.raises(ValueError):
        tokens.resistant_mask(F.col("x"), "other")
    with pytest.raises(ValueError):
        tokens.encode_outcome(F.col("x"), "other")


def test_ages(spark):
    texts = [("0",), ("4 years",), ("95",), ("≥95 years",), (None,), ("130",)]
    age = calendar.parse_age(F.col("x"))
    got = values(spark, texts, "x string", a=age, r=calendar.age_range(age), g=calendar.age_group(age))
    assert got == [
        (0, "0 years", "Pediatric"), (4, "1-4 years", "Pediatric"), (95, "≥95 years", "Elderly"), (95, "≥95 years", "Elderly"),
        (-1, None, None), (130, None, None),
    ]


def test_normal_functions(spark):
    zs = [-8.0, -7.0, -3.3, -1.0, 0.0, 0.5, 1.96, 5.0, 7.2, 40.0]
    got = values(spark, [(z,) for z in zs], "z double", c=stats.normal_cdf(F.col("z")), p=stats.two_sided_p(F.col("z")))
    for z, (c, p) in zip(zs, got):
        assert c == pytest.approx(NormalDist().cdf(z), abs=1e-13)
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6, abs=1e-300)


def test_student_quantile(spark):
    # published two-sided 5 % points
    for dof, want in ((100, 1.983972), (200, 1.971896), (1000, 1.962339)):
        got = values(spark, [(float(dof),)], "d double", q=stats.student_t_quantile(0.975, F.col("d")))[0][0]
        assert got == pytest.approx(want, abs=2e-6)


def hypergeometric_p(a, b, c, d):
    n, row, col = a + b + c + d, a + b, a + c
    pmf = lambda x: math.comb(row, x) * math.comb(n - row, col - x)
    lo, hi = max(0, col - (n - row)), min(row, col)
    obs = pmf(a)
    return sum(pmf(x) for x in range(lo, hi + 1) if pmf(x) * 10**7 <= obs * (10**7 + 1)) / math.comb(n, col)


def test_fisher(spark):
    tables = [
        (8, 2, 1, 5), (0, 10, 10, 0), (3, 3, 3, 3), (0, 5, 0, 5), (1, 0, 0, 1), (50, 450, 120, 380), (2, 998, 1, 9), (0, 3, 40, 4000),
        (300, 200, 200, 300), (7, 0, 93, 900), (400, 100, 100, 400), (1, 2000, 30, 2000),
    ]
    got = values(spark, tables, "a long, b long, c long, d long", p=stats.fisher_exact_p(*(F.col(x) for x in "abcd")))
    for t, (p,) in zip(tables, got):
        assert p == pytest.approx(hypergeometric_p(*t), rel=1e-9, abs=1e-200), t


def test_fisher_large_table(spark):
    t = (5_000_000, 45_000_000, 4_990_000, 45_010_000)
    p = values(spark, [t], "a long, b long, c long, d long", p=stats.fisher_exact_p(*(F.col(x) for x in "abcd")))[0][0]
    a, b, c, d = t
    n = a + b + c + d
    chi = (abs(a * d - b * c) - n / 2) ** 2 * n / ((a + b) * (c + d) * (a + c) * (b + d))
    assert p == pytest.approx(math.erfc(math.sqrt(chi / 2)), rel=1e-3)
