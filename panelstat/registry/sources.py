"""Reader queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelstat import session
from panelstat.sources import arrow_source, readers, writers


def read_auto(spark, sf):
    df = readers.read_any(spark, f"{sf}/orders.parquet")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("max_key"))


def mixed_load(spark, sf):
    """Several files as one table by column name, with the file each row came from."""
    loader = readers.MixedLoader(spark)
    frames = [loader.load([f"{sf}/{t}.parquet"]) for t in ("customer", "nation", "region")]
    df = readers.unite(frames)
    return df.groupBy(F.element_at(F.split("__source__", "/"), -1).alias("file")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("c_custkey").alias("n_custkey"),
        F.count("n_regionkey").alias("n_n_regionkey"),
        F.max("r_name").alias("max_r_name"),
    )


MIXED_SQL = """SELECT 'customer.parquet' AS file, count(*) AS n, count(c_custkey) AS n_custkey, CAST(0 AS BIGINT) AS n_n_regionkey, CAST(NULL AS VARCHAR) AS max_r_name FROM customer
UNION ALL SELECT 'nation.parquet', count(*), 0, count(n_regionkey), NULL FROM nation
UNION ALL SELECT 'region.parquet', count(*), 0, 0, max(r_name) FROM region"""


def needs_string(spark, sf):
    df = readers.read_any(spark, f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return readers.needs_string(df)


NEEDS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", coalesce(bool_or(CAST({c} AS VARCHAR) LIKE '0%' OR NOT regexp_full_match(CAST({c} AS VARCHAR), '[0-9]+')), false) AS needs_string FROM customer"""
    for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
)


def all_strings(spark, sf):
    return readers.all_strings(readers.read_any(spark, f"{sf}/nation.parquet"))


def _copies(spark, sf):
    """Copies of two growing tables in several formats and column orders, with a broken row per 100 events, in the shared folder."""
    out = f"{session.checkpoint_dir(spark).rstrip('/')}/mixed-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    low = F.col("o_custkey") % 3 == 0
    orders.where(low).write.option("header", "true").csv(f"{out}/a")
    orders.where(~low).select("o_custkey", "o_orderstatus", "o_orderkey").write.option("header", "true").csv(f"{out}/b")
    events.write.json(f"{out}/c")
    orders.write.parquet(f"{out}/d")
    line = F.to_json(F.struct("event_id", "event_type"))
    events.select(F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("{no json "), line)).otherwise(line)).write.text(f"{out}/e")
    jvm = spark.sparkContext._jvm
    parts = jvm.org.apache.hadoop.fs.Path(f"{out}/e/part-*")
    fs = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(parts):
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(status.getPath().toString().replace(".txt", ".json")))
    return out


def mixed_formats(spark, sf):
    """CSV files with unlike headers, JSON and Parquet as one table by column name."""
    out = _copies(spark, sf)
    df = readers.MixedLoader(spark).load([f"{out}/{x}" for x in "abcd"])
    folder = F.element_at(F.split("__source__", "/"), -2)
    return df.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_orderkey").cast("long")).alias("orders"),
        F.sum(F.col("o_custkey").cast("long")).alias("customers"),
        F.max("o_orderstatus").alias("last_status"),
        F.sum("event_id").alias("events"),
        F.max("event_type").alias("last_type"),
    )


_ORDERS = "count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customers, max(o_orderstatus) AS last_status, CAST(NULL AS BIGINT) AS events, CAST(NULL AS VARCHAR) AS last_type FROM orders"
MIXED_FORMATS_SQL = f"""SELECT CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS folder, {_ORDERS} GROUP BY 1
UNION ALL SELECT 'c', count(*), NULL, NULL, NULL, CAST(sum(event_id) AS BIGINT), max(event_type) FROM events
UNION ALL SELECT 'd', {_ORDERS}"""


def load_report(spark, sf):
    """Rows and broken rows of every folder of a lenient load."""
    out = _copies(spark, sf)
    found = readers.MixedLoader(spark).report([f"{out}/{x}" for x in "abcde"])
    name = F.regexp_extract("path", "/([a-e])/[^/]*$", 1)
    named = F.coalesce(F.bool_or((F.col("n_malformed") > 0) & F.col("error").isNotNull()), F.lit(False))
    return found.groupBy(name.alias("folder")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_malformed").alias("n_malformed"), named.alias("reported")
    )


LOAD_REPORT_SQL = """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS folder, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_malformed, false AS reported FROM orders GROUP BY 1
UNION ALL SELECT 'c', count(*), 0, false FROM events UNION ALL SELECT 'd', count(*), 0, false FROM orders
UNION ALL SELECT 'e', count(*) FILTER (event_id % 100 <> 0), count(*) FILTER (event_id % 100 = 0), count(*) FILTER (event_id % 100 = 0) > 0 FROM events"""


def saved_dataset(spark, sf):
    """A dataset written in partitions and files of few rows, replaced by a second version, read again."""
    out = f"{session.checkpoint_dir(spark).rstrip('/')}/saved-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.save_dataset(orders.where("o_orderkey % 2 = 0"), out, "orders", partition_on=["o_orderstatus"])
    writers.save_dataset(orders, out, "orders", partition_on=["o_orderstatus"], rows_per_file=1_000)
    back = readers.read_any(spark, writers.dataset_path(out, "processed", "orders", "parquet"))
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.max("o_totalprice"), 2).alias("largest")
    )


def arrow_copy(spark, sf):
    """Sums of a filtered read of Arrow copies of a table, many record batches a file."""
    out = f"{session.checkpoint_dir(spark).rstrip('/')}/arrow-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.save_arrow(orders, out, rows_per_batch=1_000)
    back = arrow_source.read(spark, out, batches_per_partition=2).where("o_orderstatus = 'F'")
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"), F.round(F.max(F.col("o_totalprice").cast("double")), 2).alias("largest")
    )


QUERIES = {
    "mixed_formats_load": (mixed_formats, MIXED_FORMATS_SQL),
    "load_report": (load_report, LOAD_REPORT_SQL),
    "saved_dataset": (
        saved_dataset,
        "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(max(o_totalprice), 2) AS largest FROM orders GROUP BY 1",
    ),
    "arrow_copy": (
        arrow_copy,
        "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(max(o_totalprice), 2) AS largest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    ),
    "read_auto_detect": (read_auto, "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS max_key FROM orders GROUP BY 1"),
    "mixed_file_load": (mixed_load, MIXED_SQL),
    "needs_string_sniff": (needs_string, NEEDS_SQL),
    "all_columns_as_text": (
        all_strings,
        "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    ),
}
