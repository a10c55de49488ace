"""Batch data source for Arrow/Feather files: ``spark.read.format("arrow_files")``.

Options: ``path`` (file, folder or glob; several joined with commas), ``recursive`` (default true),
``batches_per_partition`` (default 16), ``columns`` (names joined with commas; all by default),
``push_filters`` (default false; the session must allow it, :func:`read` sees to both). Places with a scheme are read through pyarrow's file systems (hdfs, s3, gs, file), others are local paths.

A partition is a range of a file's record batches, which are read one by one, so a large file is shared
by many tasks and never held whole. Pushed equality, comparison, membership and null filters run on the
batches, on the texts Spark would compare. Spark offers a Python source no column
pruning, so columns are named by the option (:func:`read` takes them); only those are read from the file.
Columns come out as strings, in the order of the declared schema; columns a file lacks are filled with
nulls and extra columns are ignored.
"""

from __future__ import annotations

import fnmatch
import glob
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

SOURCE = "__source__"  # with the option "source": the file of each row
EXTENSIONS = (".feather", ".ft", ".arrow")
BATCHES = 16


def _remote(path: str):
    """(file system, path, prefix of its names) of a place with a scheme."""
    from pyarrow import fs

    found, inner = fs.FileSystem.from_uri(path)
    return found, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def _listed(path: str, recursive: bool) -> Iterable[str]:
    if "://" not in path and not path.startswith("file:"):
        if os.path.isdir(path):
            pattern = os.path.join(path, "**" if recursive else "", "*")
            return (f for f in glob.glob(pattern, recursive=recursive) if f.lower().endswith(EXTENSIONS))
        return (f for f in glob.glob(path) if os.path.isfile(f))
    from pyarrow import fs

    marks = [i for i in map(path.find, "*?[") if i >= 0]
    base = path[: path.rfind("/", 0, min(marks))] if marks else path
    system, inner, prefix = _remote(base)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [base]
    files = [f.path for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=recursive or bool(marks))) if f.is_file]
    names = [prefix + f for f in files]
    return (f for f in names if (fnmatch.fnmatch(f, path) if marks else f.lower().endswith(EXTENSIONS)))


def list_files(path: str, recursive: bool = True) -> list[str]:
    return sorted({f for item in path.split(",") for f in _listed(item, recursive)})


def _open(path: str):
    import pyarrow as pa

    if "://" not in path and not path.startswith("file:"):
        return pa.memory_map(path)
    system, inner, _ = _remote(path)
    return system.open_input_file(inner)


class BatchRange(InputPartition):
    """Record batches start to stop of a file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


_COMPARE = {
    ds.EqualTo: "equal", ds.GreaterThan: "greater", ds.GreaterThanOrEqual: "greater_equal",
    ds.LessThan: "less", ds.LessThanOrEqual: "less_equal",
}


class ArrowFilesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.files = list_files(options["path"], options.get("recursive", "true").lower() == "true")
        self.step = max(1, int(options.get("batches_per_partition", BATCHES)))
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self) -> list[InputPartition]:
        """Reads the files' footers only."""
        import pyarrow.ipc as ipc

        out = []
        for path in self.files:
            with _open(path) as source:
                n = ipc.open_file(source).num_record_batches
            out += [BatchRange(path, k, min(k + self.step, n)) for k in range(0, n, self.step)]
        return out

    def _kept(self, batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        for test, name, value in self.tests:
            column = batch.column(name)
            if test in ("null", "given"):
                mask = column.is_null() if test == "null" else column.is_valid()
            elif test == "in":
                mask = pc.is_in(column, value_set=pa.array(value, pa.string()))
            else:
                mask = getattr(pc, test)(column, pa.scalar(value, pa.string()))
            batch = batch.filter(mask)
        return batch

    def read(self, partition: BatchRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.ipc as ipc

        with _open(partition.path) as source:
            names = ipc.open_file(source).schema.names
            wanted = [names.index(c) for c in self.columns if c in names]
            # no index at all would mean every column
            reader = ipc.open_file(source, options=ipc.IpcReadOptions(included_fields=wanted)) if wanted else ipc.open_file(source)
            names = reader.schema.names
            for i in range(partition.start, partition.stop):
                batch = reader.get_batch(i)
                here = pa.array([partition.path] * batch.num_rows, pa.string())
                arrays = [
                    here if c == SOURCE
                    else pc.cast(batch.column(names.index(c)), pa.string()) if c in names
                    else pa.nulls(batch.num_rows, pa.string())
                    for c in self.columns
                ]
                yield self._kept(pa.RecordBatch.from_arrays(arrays, names=self.columns))


class FilteringReader(ArrowFilesReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes comparisons of a column with texts and null checks; gives the others back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.columns or name == SOURCE:
                yield f
            elif type(f) in _COMPARE and isinstance(f.value, str):
                self.tests.append((_COMPARE[type(f)], name, f.value))
            elif isinstance(f, ds.In) and all(isinstance(v, str) for v in f.value):
                self.tests.append(("in", name, list(f.value)))
            elif isinstance(f, ds.IsNotNull | ds.IsNull):
                self.tests.append(("null" if isinstance(f, ds.IsNull) else "given", name, None))
            else:
                yield f


class ArrowFilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        """Union of the columns of all files (only footers are read)."""
        import pyarrow.ipc as ipc

        names: dict[str, None] = {}
        for f in list_files(self.options["path"], self.options.get("recursive", "true").lower() == "true"):
            with _open(f) as source:
                names.update(dict.fromkeys(ipc.open_file(source).schema.names))
        if not names:
            raise FileNotFoundError(f"no arrow files under {self.options['path']}")
        if self.options.get("columns"):
            names = dict.fromkeys(c for c in self.options["columns"].split(",") if c in names)
        listed = [SOURCE, *names] if self.options.get("source", "false").lower() == "true" else list(names)
        return StructType([StructField(n, StringType(), True) for n in listed])

    def reader(self, schema: StructType) -> DataSourceReader:
        # Spark refuses a reader that takes filters unless the session lets Python sources do so
        pushing = self.options.get("push_filters", "false").lower() == "true"
        return (FilteringReader if pushing else ArrowFilesReader)(schema, self.options)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Arrow files as text columns, filters run inside the source. Sets the session's filter pushdown of Python sources."""
    spark.dataSource.register(ArrowFilesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options["push_filters"] = "true"
    if columns:
        options["columns"] = ",".join(columns)
    return spark.read.format("arrow_files").options(**{k: str(v) for k, v in options.items()}).load(path)
