"""Isolate tables derived from an order-management star schema.

An order plays the isolate, a part brand the drug, the worst return flag of a brand within an
order the outcome, the customer's nation the laboratory. All derived columns are deterministic
functions of keys, so any SQL engine reproduces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.functions import calendar

# brand names of the part table: the drug catalogue of the derived data
CODES = [f"Brand#{i}" for i in range(1, 26)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(selector: Column, values: list[str | None]) -> Column:
    """values[selector] with null entries and a null beyond the end."""
    return F.try_element_at(F.array(*[F.lit(v).cast("string") for v in values]), selector.cast("int") + 1)


# Dirty spellings of a raw result, by (order key + line number) modulo 11.
DIRTY_TOKENS = [" r ", "R/S", "n/a", "res", "0", "1", "-", "", "I.", "s,"]


def raw_token() -> Column:
    """The line's return flag as a laboratory might have typed it."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    return F.coalesce(_pick(k, DIRTY_TOKENS), F.col("l_returnflag"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey)


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isolate_id, tests: array<struct<code, outcome>> sorted by code.

    One shuffle on the order key. collect_set runs map-side and holds at most
    (catalogue x outcomes) entries, so an order with any number of lines stays small.
    """
    severity = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    seen = (
        _lines(spark, sf_dir)
        .groupBy(F.col("l_orderkey").alias("isolate_id"))
        .agg(F.collect_set(F.struct(F.col("p_brand").alias("code"), severity.alias("sev"))).alias("seen"))
    )
    codes = F.array_sort(F.array_distinct(F.transform("seen", lambda s: s["code"])))
    worst = F.transform(
        codes,
        lambda c: F.struct(
            c.alias("code"),
            _pick(
                F.array_max(F.transform(F.filter("seen", lambda s: s["code"] == c), lambda s: s["sev"])) - 1,
                ["S", "I", "R"],
            ).alias("outcome"),
        ),
    )
    return seen.select("isolate_id", worst.alias("tests"))


def raw_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isolate_id, raw: map<code, dirty token> (the first line of a brand gives the token)."""
    first = (
        _lines(spark, sf_dir)
        .groupBy(F.col("l_orderkey").alias("isolate_id"), F.col("p_brand").alias("code"))
        .agg(F.min(F.struct("l_linenumber", raw_token().alias("token"))).alias("first"))
    )
    return first.groupBy("isolate_id").agg(
        F.map_from_entries(F.collect_list(F.struct("code", F.col("first.token").alias("token")))).alias("raw")
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolate attributes, one row per order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    age = F.when(F.col("o_custkey") % 50 != 0, F.floor((F.col("c_acctbal") + 1000) / 110).cast("int"))
    excluded = F.col("o_orderstatus") == "P"
    flag_text = F.when(excluded, _pick(F.col("o_orderkey") % 4, ["true", "1", "Yes", " T "])).otherwise(
        _pick(F.col("o_orderkey") % 4, ["false", "0", "no", None])
    )
    return joined.select(
        F.col("o_orderkey").alias("isolate_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("n_name").alias("lab"),
        F.col("r_name").alias("pathogen_group"),
        F.col("o_orderpriority").alias("ward"),
        F.col("c_mktsegment").alias("care_type"),
        F.concat(age.cast("string"), F.lit(" years")).alias("patient_age"),
        calendar.age_group(F.coalesce(age, F.lit(-1))).alias("age_group"),
        F.year("o_orderdate").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
        _pick(F.col("o_custkey") % 7, ["w", "m", "u", "o", "d", None, "x"]).alias("sex"),
        F.when(F.col("o_orderkey") % 3 == 0, flag_text).otherwise("0").alias("excl_screening"),
        F.when(F.col("o_orderkey") % 3 == 1, flag_text).otherwise("false").alias("excl_pathogen"),
        F.when(F.col("o_orderkey") % 3 == 2, flag_text).alias("excl_negative"),
    )


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes and panel; both sides are keyed by the order, so the join reuses its partitioning."""
    return meta(spark, sf_dir).join(panels(spark, sf_dir), "isolate_id")


# German labels of a raw export.
MATERIALS_DE = [
    "Urin", "Wunde", "Abstrich", "respiratorisch", "Blutkultur", "Stuhlproben",
    "Urogenitalabstrich", "Punktat", "sonstiges", "Ausschluss", "unbekannt",
]
LEVELS_DE = [
    "Level 1 - Grundversorgung", "Level 2 - Regelversorgung", "Level 3 - Schwerpunktversorgung",
    "Level 4 - Maximalversorgung", "Level 5 - Fachkrankenhäuser", "Level 6 - Sonstige Krankenhäuser",
    "Level 7 - Vorsorge- und Rehabilitationseinrichtung", "nicht zugeordnet",
]
WARDS_DE = [
    "Normalstation", "ambulant", "Intensivstation", "sonstige Behandlungsart",
    "Intermediate Care/Wachstation", "Rehabilitation", "OP", "Frührehabilitation", "unbekannt", "Tagesklinik",
]
GROUPS_DE = [
    "gram-negativ: Enterobacterales", "gram-positiv: Streptokokken", "gram-positiv: Staphylokokken",
    "gram-negativ: Nonfermenter", "gram-positiv: andere", "Anaerobier", "gram-negativ: andere",
    "gram-positiv: Enterokokken", "sonstige",
]
PATHOGENS = [
    "Escherichia coli", "Klebsiella pneumoniae", "Staphylococcus aureus", "Pseudomonas aeruginosa",
    "Streptococcus pneumoniae", "Proteus mirabilis", "Candida albicans", "Haemophilus influenzae",
]
REGIONS_DE = ["West", "Südost", "Nordost", "Südwest", "Nordwest", "unbekannt"]
ORGANISATIONS_DE = ["Krankenhaus", "Arztpraxis", "Andere", "MVZ"]


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw wide export: attributes with German labels plus one text column per drug."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    age = F.when(cust % 50 != 0, F.floor((F.col("c_acctbal") + 1000) / 110).cast("int"))
    attributes = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .select(
            key.alias("IdIsolateDW"),
            cust.alias("IdPatientDW"),
            F.when(key % 97 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
            _pick(key % len(PATHOGENS), PATHOGENS).alias("Pathogen"),
            F.split(_pick(key % len(PATHOGENS), PATHOGENS), " ")[0].alias("PathogenGenus"),
            _pick(key % len(GROUPS_DE), GROUPS_DE).alias("PathogengroupL1"),
            _pick(key % (len(MATERIALS_DE) + 1), [*MATERIALS_DE, None]).alias("TextMaterialgroupRkiL0"),
            _pick(cust % len(REGIONS_DE), REGIONS_DE).alias("ARS_Region"),
            _pick(key % len(WARDS_DE), WARDS_DE).alias("ARS_WardType"),
            _pick(cust % (len(LEVELS_DE) + 1), [*LEVELS_DE, None]).alias("ARS_HospitalLevelManual"),
            F.col("n_name").alias("ARS_LabName"),
            _pick(cust % len(ORGANISATIONS_DE), ORGANISATIONS_DE).alias("TypeOrganisation"),
            _pick(key % 3, ["ambulant", "stationär", "teilstationär"]).alias("CareType"),
            _pick(cust % 7, ["w", "m", "u", "o", "d", None, "x"]).alias("Sex"),
            F.concat(age.cast("string"), F.lit(" years")).alias("PatientAge"),
        )
    )
    raw = raw_panels(spark, sf_dir).withColumnRenamed("isolate_id", "IdIsolateDW")
    return attributes.join(raw, "IdIsolateDW").select(
        *attributes.columns,
        *[F.try_element_at("raw", F.lit(code)).alias(drug_column(code)) for code in CODES],
    )


def drug_column(code: str) -> str:
    """Column label of a drug in the derived export."""
    return f"{code} - Drug {code.split('#')[1]}"
