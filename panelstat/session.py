"""Session helper for tests, benches and local runs; clusters bring their own session."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "panelstat") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANELSTAT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only for a local master without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelstat-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the plan at a table written to the shared checkpoint folder. Runs a job.

    Unlike cached blocks the table survives lost executors; unlike a row checkpoint later readers
    still prune columns, push filters and see its size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/panelstat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it the shuffle files of a query go when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


MAX_BROADCAST_ROWS = 10_000


def small_side(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A dimension ready to be joined to a large table.

    Runs the dimension and counts it: within the bound it becomes a broadcast local table, so the
    large side is neither shuffled nor skewed by hot keys; beyond it the plain table is returned and
    the join is left to the optimizer.
    """
    rows = dim.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return dim
    return F.broadcast(dim.sparkSession.createDataFrame(rows, dim.schema))
