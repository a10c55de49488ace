"""Dataset and result writers."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.operators import coverage
from panelstat.sources import arrow_source
from panelstat.sources.readers import CURRENT, current_versions, drop_unnamed

# Default codec per format and rows per file.
DEFAULT_COMPRESSION = {"parquet": "zstd", "csv": "gzip"}
ROWS_PER_FILE = 250_000

# Categorical columns whose distinct values are listed.
UNIQUE_COLUMNS = [
    "TextMaterialgroupRkiL0", "Pathogen", "PathogenGenus", "ARS_Region", "ARS_WardType", "ARS_HospitalLevelManual",
    "TypeOrganisation", "CareType", "PathogengroupL1", "GramType", "Sex", "AgeGroup", "AgeRange", "BroadAgeGroup",
    "HighLevelAgeRange", "Hospital_Priority", "Care_Complexity", "Facility_Function", "Year",
]


def slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("_")


def dataset_path(base: str, stage: str, name: str, fmt: str) -> str:
    return f"{base.rstrip('/')}/{stage}/{slug(name)}/dataset_{fmt}"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file through the Hadoop file system, so any cluster storage works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(target, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file put in place by one atomic rename: readers see the old text or the new."""
    staged = f"{path}.{uuid.uuid4().hex}"
    _write_text(spark, staged, text)
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(conf).makeQualified(source).toUri(), conf)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(source, target, options)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save_dataset(
    df: DataFrame,
    base: str,
    name: str,
    stage: str = "processed",
    fmt: str = "parquet",
    compression: str | None = None,
    partition_on: list[str] | None = None,
    rows_per_file: int | None = None,
) -> str:
    """Writes a new version of a dataset with a ``_dataset.json`` beside its data files; returns its folder.

    The stored version stays as it is, and readable, until the new one is whole: one atomic rename of
    ``_current.json`` then names the new folder, which :func:`readers.read_any` follows from the dataset's
    folder. A write that fails leaves the old rows. The version before the new one is kept for those
    still reading it, older ones are deleted. Of two writers at once the last to end is current.

    Spark takes names that start with "_metadata" for Parquet footers, hence the file name.

    Every task writes its own files and the committer publishes them together. The row count in
    the metadata is observed during the write. An empty input raises before anything is written.
    """
    if fmt not in DEFAULT_COMPRESSION:
        raise ValueError(f"format must be one of {sorted(DEFAULT_COMPRESSION)}")
    from pyspark.sql import Observation

    df = drop_unnamed(df)
    if df.isEmpty():
        raise ValueError("no rows to save; the stored dataset is left as it is")
    spark, folder = df.sparkSession, dataset_path(base, stage, name, fmt)
    kept = current_versions(spark, folder)
    version = f"v-{uuid.uuid4().hex}"
    out = f"{folder}/{version}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    codec = compression or DEFAULT_COMPRESSION[fmt]
    writer = counted.write.mode("overwrite").format(fmt).option("compression", codec)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", int(rows_per_file))
    if partition_on:
        writer = writer.partitionBy(*partition_on)
    try:
        writer.save(out)
    except Exception:
        _delete(spark, out)
        raise
    meta = {
        "created_utc": datetime.now(timezone.utc).isoformat(),
        "format": fmt,
        "compression": codec,
        "stage": stage,
        "name": name,
        "rows": seen.get["rows"],
        "cols": len(df.columns),
        "dtypes": dict(df.dtypes),
        "partition_on": partition_on or [],
        "rows_per_file": rows_per_file or 0,
    }
    _write_text(spark, f"{out}/_dataset.json", json.dumps(meta, indent=2, ensure_ascii=False))
    _replace_text(spark, f"{folder}/{CURRENT}", json.dumps({"versions": [version, *kept[:1]]}))
    for old in kept[1:]:
        _delete(spark, f"{folder}/{old}")
    return out


def save_flat(df: DataFrame, out: str, rows_per_file: int = ROWS_PER_FILE, compression: str = "zstd") -> str:
    """Plain Parquet folder without partition columns."""
    drop_unnamed(df).write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_per_file).parquet(out)
    return out


def save_arrow(df: DataFrame, out: str, rows_per_batch: int = 10_000) -> str:
    """Arrow (Feather) files, one a task, through pyarrow's file systems. Returns the folder, which must be new or empty.

    A task writes under a name of its own and renames at its end, so a lost or repeated attempt leaves
    no cut file; the file's name is its partition's, so a repeated attempt adds none.
    """
    from pyspark import TaskContext

    if arrow_source.list_files(out):
        raise FileExistsError(f"{out} holds files already")
    schema_of = df.sparkSession.createDataFrame([], df.schema).toArrow().schema

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs, ipc

        system, folder = fs.FileSystem.from_uri(out) if "://" in out or out.startswith("file:") else (fs.LocalFileSystem(), out)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}"
        staged, rows = f"{name}.{uuid.uuid4().hex}", 0
        with system.open_output_stream(staged) as sink, ipc.new_file(sink, schema_of) as writer:
            for batch in batches:
                for k in range(0, batch.num_rows, rows_per_batch):
                    part = batch.slice(k, rows_per_batch)
                    writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema_of)], schema=schema_of))
                    rows += part.num_rows
        if system.get_file_info(f"{name}.arrow").is_file:  # an earlier attempt of the same partition got there
            system.delete_file(staged)
        else:
            system.move(staged, f"{name}.arrow")
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    df.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return out


def save_results(results: DataFrame, out: str, config: dict, cohort: dict | None = None) -> dict[str, str]:
    """Pair results as CSV plus a manifest with configuration and cohort facts."""
    flat = results.select(
        *[F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in results.dtypes]
    )
    paths = {"results": f"{out}/results", "manifest": f"{out}/manifest.json"}
    flat.write.mode("overwrite").option("header", "true").csv(paths["results"])
    manifest = {"created_utc": datetime.now(timezone.utc).isoformat(), "config": config, "cohort": cohort or {}}
    _write_text(results.sparkSession, paths["manifest"], json.dumps(manifest, indent=2, default=str))
    return paths


def load_results(spark: SparkSession, out: str) -> tuple[DataFrame, dict]:
    manifest = "\n".join(r.value for r in spark.read.text(f"{out}/manifest.json").collect())
    return spark.read.option("header", "true").option("inferSchema", "true").csv(f"{out}/results"), json.loads(manifest)


def save_unique_values(df: DataFrame, out: str, columns: list[str] | None = None) -> DataFrame:
    """Distinct values of categorical columns, one CSV folder per column, from one job."""
    values = coverage.unique_values(df, columns or UNIQUE_COLUMNS)
    values.write.mode("overwrite").option("header", "true").partitionBy("column").csv(out)
    return values
