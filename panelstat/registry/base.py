"""SQL text shared by the oracles: the isolate model as common table expressions."""

from __future__ import annotations

from panelstat.sources import warehouse

CODES = warehouse.CODES
CODE_VALUES = ", ".join(f"('{c}')" for c in CODES)

# (isolate_id, code, outcome): one row per tested drug
TESTS = """tests AS (
  SELECT l_orderkey AS isolate_id, p_brand AS code,
         CASE max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END)
              WHEN 3 THEN 'R' WHEN 2 THEN 'I' ELSE 'S' END AS outcome
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey, p_brand)"""

RAW_TOKEN = """CASE (l_orderkey + l_linenumber) % 11
    WHEN 0 THEN ' r ' WHEN 1 THEN 'R/S' WHEN 2 THEN 'n/a' WHEN 3 THEN 'res' WHEN 4 THEN '0' WHEN 5 THEN '1'
    WHEN 6 THEN '-' WHEN 7 THEN '' WHEN 8 THEN 'I.' WHEN 9 THEN 's,' ELSE l_returnflag END"""

# (isolate_id, code, raw): the first line of a brand gives the text
RAW = f"""raw AS (
  SELECT isolate_id, code, raw FROM (
    SELECT l_orderkey AS isolate_id, p_brand AS code, {RAW_TOKEN} AS raw,
           row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_linenumber, {RAW_TOKEN}) AS rn
    FROM lineitem JOIN part ON l_partkey = p_partkey) x
  WHERE rn = 1)"""

AGE_GROUP = """CASE WHEN age IS NULL THEN NULL WHEN age < 15 THEN 'Pediatric' WHEN age < 25 THEN 'Adolescents & Young Adults'
    WHEN age < 65 THEN 'Adult' WHEN age < 120 THEN 'Elderly' END"""

FLAG_TEXT = """CASE WHEN o_orderstatus = 'P' THEN (CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' ELSE ' T ' END)
    ELSE (CASE o_orderkey % 4 WHEN 0 THEN 'false' WHEN 1 THEN '0' WHEN 2 THEN 'no' END) END"""

META = f"""meta AS (
  SELECT isolate_id, patient_id, lab, pathogen_group, ward, care_type,
         CAST(age AS VARCHAR) || ' years' AS patient_age, {AGE_GROUP} AS age_group,
         year, year_month, sex, excl_screening, excl_pathogen, excl_negative
  FROM (
    SELECT o_orderkey AS isolate_id, o_custkey AS patient_id, n_name AS lab, r_name AS pathogen_group,
           o_orderpriority AS ward, c_mktsegment AS care_type,
           CASE WHEN o_custkey % 50 <> 0 THEN CAST(floor((c_acctbal + 1000) / 110) AS INTEGER) END AS age,
           CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS year_month,
           CASE o_custkey % 7 WHEN 0 THEN 'w' WHEN 1 THEN 'm' WHEN 2 THEN 'u' WHEN 3 THEN 'o' WHEN 4 THEN 'd'
                WHEN 6 THEN 'x' END AS sex,
           CASE WHEN o_orderkey % 3 = 0 THEN {FLAG_TEXT} ELSE '0' END AS excl_screening,
           CASE WHEN o_orderkey % 3 = 1 THEN {FLAG_TEXT} ELSE 'false' END AS excl_pathogen,
           CASE WHEN o_orderkey % 3 = 2 THEN {FLAG_TEXT} END AS excl_negative
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey) m)"""

# isolates with at least one test
ISO = "iso AS (SELECT * FROM meta WHERE isolate_id IN (SELECT isolate_id FROM tests))"

# R flag per tested drug with I kept as non-resistant
FLAGS = "flags AS (SELECT isolate_id, code, CASE WHEN outcome = 'R' THEN 1 ELSE 0 END AS r FROM tests)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def tail(z: str) -> str:
    """P(Z > |z|) as SQL; z should be a plain column name."""
    from panelstat.functions import stats

    a = f"abs({z})"

    def horner(cs: list[float]) -> str:
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {a} + {c!r}::DOUBLE)"
        return out

    density = f"exp(-{a} * {a} / 2)"
    fraction = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        fraction = f"({a} + {k}.0::DOUBLE / {fraction})"
    return (
        f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {stats.TAIL_SWITCH!r} "
        f"THEN {density} * {horner(stats.TAIL_NUMERATOR)} / {horner(stats.TAIL_DENOMINATOR)} "
        f"ELSE {density} / {fraction} / {stats.SQRT_TWO_PI!r}::DOUBLE END"
    )


def hash_bucket(text: str) -> str:
    """First 32 bits of md5 as a BIGINT."""
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
