"""Readers: one path with format detection, or many files in mixed formats as one table."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat.operators import coverage
from panelstat.sources.arrow_source import EXTENSIONS as ARROW_EXTENSIONS
from panelstat.sources.arrow_source import ArrowFilesSource

UNNAMED = re.compile(r"^Unnamed(?::\s*\d+)?$")
ARTIFACT_SUFFIX = "_Tested_Outcome"

# Spark format per file extension.
FORMATS = {".parquet": "parquet", ".csv": "csv", ".csv.gz": "csv", ".json": "json", **dict.fromkeys(ARROW_EXTENSIONS, "arrow_files")}
DEFAULT_OPTIONS = {"csv": {"header": "true", "inferSchema": "true"}}

Reader = Callable[[SparkSession, list[str]], DataFrame]


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if UNNAMED.match(c)])


def drop_artifacts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(ARTIFACT_SUFFIX)])


def require_unique_columns(df: DataFrame) -> DataFrame:
    dupes = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if dupes:
        raise ValueError(f"column names must differ; repeated: {dupes[:25]}")
    blank = [c for c in df.columns if not c.strip()]
    if blank:
        raise ValueError(f"{len(blank)} columns have no name")
    return df


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(".csv.gz"):
        return ".csv.gz"
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


CURRENT = "_current.json"


def current_versions(spark: SparkSession, folder: str) -> list[str]:
    """Versions of a saved dataset, the current one first; none in other folders."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{CURRENT}")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if any(c in folder for c in "*?{[") or not fs.exists(place):
        return []
    stream = fs.open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["versions"]
    finally:
        stream.close()


def read_any(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Folders and .parquet as Parquet, Arrow/Feather files as text columns, anything else as CSV.

    The folder of a saved dataset is read at its current version, in the format it was saved in."""
    ext = extension(path)
    versions = current_versions(spark, path) if not ext else []
    if versions:
        path = f"{path.rstrip('/')}/{versions[0]}"
        ext = ".csv" if "/dataset_csv/" in path else ""
    if ext in ("", ".parquet"):
        df = spark.read.options(**options).parquet(path)
    elif ext in ARROW_EXTENSIONS:
        spark.dataSource.register(ArrowFilesSource)
        df = spark.read.format("arrow_files").options(**options).load(path)
    else:
        df = spark.read.options(**{**DEFAULT_OPTIONS["csv"], **options}).csv(path)
    return drop_unnamed(df)


MALFORMED = "__malformed__"


def _well_formed(df: DataFrame) -> Column:
    """True for rows without a malformed text. Spark reads that column only beside another, hence the
    condition on the others, which always holds."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in (MALFORMED, "__source__")]
    return F.col(MALFORMED).isNull() & (F.hash(*others) >= F.lit(-(2**31))) if others else F.col(MALFORMED).isNull()


class MixedLoader:
    """Loads folders, globs and files of several formats into one table.

    Files are grouped per format, CSV files also per header, and every group is one scan; the groups
    are united by name with missing columns filled. With ``fail_fast`` an unreadable file or row stops
    the load; otherwise it is left out and listed by :meth:`report`. A ``schema`` (columns of any
    file, in any order) spares the type inference of CSV and JSON files.
    """

    def __init__(
        self, spark: SparkSession, fail_fast: bool = False, drop_unnamed_columns: bool = True, drop_empty_columns: bool = False,
        schema: T.StructType | str | None = None,
    ):
        self.spark = spark
        self.fail_fast = fail_fast
        self.drop_unnamed_columns = drop_unnamed_columns
        self.drop_empty_columns = drop_empty_columns
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.custom: dict[str, Reader] = {}

    def register_reader(self, ext: str, reader: Reader) -> None:
        """Custom reader for an extension; takes (spark, paths) and returns a DataFrame."""
        self.custom["." + ext.lower().lstrip(".")] = reader

    def _files(self, fmt: str, paths: list[str], ext: str, recursive: bool) -> DataFrameReader:
        reader = self.spark.read.format(fmt)
        if recursive:
            reader = reader.option("recursiveFileLookup", "true")
        if any(extension(p) == "" for p in paths):
            reader = reader.option("pathGlobFilter", f"*{ext}")
        return reader

    def _headers(self, paths: list[str], ext: str, recursive: bool) -> dict[str, list[str]]:
        """Header line -> files. One text scan; the driver needs the file names to start the scans anyway."""
        lines = self._files("text", paths, ext, recursive).load(paths)
        first = lines.where(F.col("_metadata.file_block_start") == 0).select(
            F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at")
        )
        groups: dict[str, list[str]] = {}
        for r in first.groupBy("path").agg(F.min_by("value", "at").alias("header")).orderBy("path").collect():
            groups.setdefault(r.header, []).append(r.path)
        return groups

    def _typed(self, reader: DataFrameReader, paths: list[str], fmt: str, options: dict[str, str]) -> DataFrame:
        """A text format with its types given or inferred, malformed rows marked unless they stop the load."""
        reader = reader.option("columnNameOfCorruptRecord", MALFORMED)
        if self.schema is None:
            found = T.StructType([f for f in reader.load(paths).schema.fields if f.name != MALFORMED])
            if not found.fields and not self.fail_fast:  # not one good row
                return self.spark.read.text(paths).withColumnRenamed("value", MALFORMED)
        elif fmt == "csv":
            names = self.spark.read.options(**{"header": "true", **options}).csv(paths[:1]).columns
            given = {f.name: f for f in self.schema.fields}
            found = T.StructType([given.get(n, T.StructField(n, T.StringType())) for n in names])
        else:
            found = self.schema
        if self.fail_fast:
            return reader.option("mode", "FAILFAST").schema(found).load(paths)
        marked = T.StructType([*found.fields, T.StructField(MALFORMED, T.StringType())])
        return reader.option("mode", "PERMISSIVE").schema(marked).load(paths)

    def _group(self, paths: list[str], ext: str, recursive: bool, options: dict[str, str], add_source: bool) -> DataFrame:
        if ext in self.custom:
            df = self.custom[ext](self.spark, paths)
            return df.select(F.input_file_name().alias("__source__"), "*") if add_source else df
        fmt = FORMATS.get(ext)
        if fmt is None:
            raise ValueError(f"no reader for {ext!r} files")
        if fmt == "arrow_files":
            self.spark.dataSource.register(ArrowFilesSource)
            reader = self.spark.read.format(fmt).options(recursive=str(recursive).lower(), source=str(add_source).lower(), **options)
            return reader.load(",".join(paths))
        options = {"ignoreCorruptFiles": str(not self.fail_fast).lower(), **DEFAULT_OPTIONS.get(fmt, {}), **options}
        source = [F.col("_metadata.file_path").alias("__source__")] if add_source else []
        if fmt == "csv" and str(options.get("header")).lower() == "true":
            frames = [
                self._typed(self.spark.read.format(fmt).options(**options), files, fmt, options).select(*source, "*")
                for _, files in sorted(self._headers(paths, ext, recursive).items())
            ]
            return unite(frames)
        reader = self._files(fmt, paths, ext, recursive).options(**options)
        if fmt == "parquet":
            return reader.option("mergeSchema", "true").load(paths).select(*source, "*")
        return self._typed(reader, paths, fmt, options).select(*source, "*")

    def _by_extension(self, paths: Iterable[str], extensions: Iterable[str]) -> dict[str, list[str]]:
        groups: dict[str, list[str]] = {}
        for p in paths:
            for e in [extension(p)] if extension(p) else [e.lower() for e in extensions]:
                groups.setdefault(e, []).append(p)
        if not groups:
            raise FileNotFoundError("no paths to load")
        return groups

    def load(
        self,
        paths: Iterable[str],
        extensions: Iterable[str] = (".parquet", ".csv", ".json"),
        recursive: bool = True,
        add_source: bool = True,
        reader_options: dict[str, dict[str, str]] | None = None,
        concat: bool = True,
    ) -> DataFrame | dict[str, DataFrame]:
        """Paths with an extension are read as such; bare paths are folders searched for ``extensions``."""
        frames = {}
        for ext, group in self._by_extension(paths, extensions).items():
            df = self._group(group, ext, recursive, (reader_options or {}).get(ext, {}), add_source)
            if MALFORMED in df.columns:
                df = df.where(_well_formed(df)).drop(MALFORMED)
            if self.drop_unnamed_columns:
                df = drop_unnamed(df)
            if self.drop_empty_columns:
                df = coverage.drop_empty_columns(df)
            frames[ext] = df
        if not concat:
            return frames
        return unite(list(frames.values()))

    def report(
        self, paths: Iterable[str], extensions: Iterable[str] = (".parquet", ".csv", ".json"), recursive: bool = True,
        reader_options: dict[str, dict[str, str]] | None = None,
    ) -> DataFrame:
        """(path, n_rows, n_malformed, error) for every file a lenient load meets; error is null for good ones.

        Counts rows per file. A file without rows that is not empty was unreadable.
        """
        out = []
        for ext, group in self._by_extension(paths, extensions).items():
            listed = self._files("binaryFile", group, ext, recursive).load(group).select("path", "length")
            df = self._group(group, ext, recursive, (reader_options or {}).get(ext, {}), True)
            good = _well_formed(df) if MALFORMED in df.columns else F.lit(True)
            counts = df.groupBy("__source__").agg(F.count_if(good).alias("n_rows"), F.count_if(~good).alias("n_malformed"))
            place = lambda c: F.regexp_replace(c, "^file:/+", "/")
            counts = counts.select(place("__source__").alias("path"), "n_rows", "n_malformed")
            out.append(listed.select(place("path").alias("path"), "length").join(counts, "path", "left"))
        files = reduce(DataFrame.unionByName, out)
        error = (
            F.when(F.col("n_rows").isNull() & (F.col("length") > 0), "unreadable, or without rows")
            .when(F.col("n_malformed") > 0, F.concat(F.col("n_malformed").cast("string"), F.lit(" malformed rows")))
        )
        zero = F.lit(0).cast("long")
        return files.select(
            "path", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_malformed", zero).alias("n_malformed"), error.alias("error")
        )


def unite(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side are filled with nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def all_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def needs_string(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, needs_string): any value with a leading zero or a non-digit, over all rows."""
    columns = columns or df.columns
    aggs = []
    for i, c in enumerate(columns):
        s = F.col(f"`{c}`").cast("string")
        aggs.append(F.coalesce(F.bool_or(s.startswith("0") | ~s.rlike(r"^\d+$")), F.lit(False)).alias(f"__n{i}"))
    flags = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("needs_string")) for i, c in enumerate(columns)])
    return flags.select(F.inline(rows))


def read_csv_safely(spark: SparkSession, path: str, force_string: Iterable[str] = ("KreisZiffer",), **options: str) -> DataFrame:
    """CSV with inferred types in which codes stay text: forced columns and columns that look like
    codes (leading zero, non-digits) are read as strings. Runs the inference and one aggregate."""
    opts = {"header": "true", **options}
    text = spark.read.options(**opts).csv(path)
    verdicts = {r["column"]: r["needs_string"] for r in needs_string(text).collect()}  # one row per column
    inferred = spark.read.options(**opts, inferSchema="true").csv(path).schema
    keep_number = {f.name for f in inferred.fields if isinstance(f.dataType, T.NumericType | T.BooleanType | T.TimestampType)}
    forced = set(force_string)
    schema = T.StructType(
        [
            f if f.name in keep_number and f.name not in forced and not (verdicts[f.name] and isinstance(f.dataType, T.IntegralType))
            else T.StructField(f.name, T.StringType(), True)
            for f in inferred.fields
        ]
    )
    return spark.read.options(**opts).schema(schema).csv(path)
