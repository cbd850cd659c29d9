"""Reads of chosen Parquet row groups: a Python data source with a partition a row group.

Conditions on columns are part of the source's options. At planning footers' smallest and
largest values decide which row groups are opened at all; gates on the number of conditions
and on bytes stop a plan before anything is read. What the statistics can't decide Spark
filters afterwards. (Filters that Spark itself pushes into a Python source are kept in an
object that all uses of a DataFrame share, so that a second use would get the first one's
rows; that is why they aren't used here.)
Footers are read by threads of the driver, or taken from an index that footer_index() made
as a Spark job. Paths must be readable by pyarrow from driver and executors.

Defined cases: a row group without statistics of a column is read; null meets no
condition; no row group left is an empty result, not an error, unless a count is expected;
files are read in the order of their names.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

THREADS, BATCH = 16, 1 << 15


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def parquet_files(path: str) -> list[str]:
    """A file, or the Parquet files below a folder, by name."""
    fs, at = opened(path)
    if fs.get_file_info(at).type == pa.fs.FileType.File:
        return [at]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == pa.fs.FileType.File and f.path.endswith(".parquet"))


@dataclass
class Group(InputPartition):
    file: str
    row_group: int
    rows: int
    bytes: int
    low: dict
    high: dict


def footer(fs: pa.fs.FileSystem, file: str, columns: list[str] | None) -> list[Group]:
    """The row groups of a file, with the bytes of the columns asked for and the limits that their statistics state."""
    with fs.open_input_file(file) as f:
        meta = pq.read_metadata(f)
    out = []
    for g in range(meta.num_row_groups):
        group, size, low, high = meta.row_group(g), 0, {}, {}
        for c in range(meta.num_columns):
            column = group.column(c)
            name = column.path_in_schema
            if columns is None or name.split(".")[0] in columns:
                size += column.total_compressed_size
            stats = column.statistics
            if stats is not None and stats.has_min_max:
                low[name], high[name] = stats.min, stats.max
        out.append(Group(file, g, group.num_rows, size, low, high))
    return out


def may_hold(group: Group, name: str, test) -> bool:
    return name not in group.low or test(group.low[name], group.high[name])


#: What a condition can say, of a row group's limits and of a column.
LIMITS = {
    "=": lambda v: lambda lo, hi: lo <= v <= hi,
    "in": lambda v: lambda lo, hi: any(lo <= x <= hi for x in v),
    ">": lambda v: lambda lo, hi: hi > v,
    ">=": lambda v: lambda lo, hi: hi >= v,
    "<": lambda v: lambda lo, hi: lo < v,
    "<=": lambda v: lambda lo, hi: lo <= v,
}
COLUMNS = {
    "=": lambda c, v: c == v,
    "in": lambda c, v: c.isin(v),
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


class RowGroupReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema, full: pa.Schema):
        self.options, self.names = options, schema.names
        typed = lambda name, v: [typed(name, x) for x in v] if isinstance(v, list) else pa.scalar(v).cast(full.field(name).type).as_py()
        self.tests = [(name, LIMITS[op](typed(name, value))) for name, op, value in json.loads(options.get("where", "[]"))]

    def partitions(self):
        fs, _ = opened(self.options["path"])
        if "index" in self.options:
            groups = from_index(self.options["index"])
        else:
            with ThreadPoolExecutor(THREADS) as pool:
                groups = [g for each in pool.map(lambda f: footer(fs, f, self.names), parquet_files(self.options["path"])) for g in each]
        kept = [g for g in groups if g.rows and all(may_hold(g, name, test) for name, test in self.tests)]
        if "expected" in self.options:
            keys = self.options["keys"].split(",")
            mixed = [g for g in kept if any(g.low.get(k) != g.high.get(k) or k not in g.low for k in keys)]
            found = {tuple(g.low[k] for k in keys) for g in kept if g not in mixed}
            if mixed or len(found) != int(self.options["expected"]):
                raise ValueError(f"{len(found)} conditions of {self.options['expected']}, {len(mixed)} row groups that hold several")
        size = sum(g.bytes for g in kept)
        if size > int(self.options.get("most_bytes", size)):
            raise ValueError(f"{size} bytes, at most {self.options['most_bytes']}")
        for g in kept:
            g.low = g.high = {}  # no need of them in tasks
        return kept or [Group("", 0, 0, 0, {}, {})]

    def read(self, partition):
        if not partition.file:
            return
        fs, _ = opened(self.options["path"])
        with fs.open_input_file(partition.file) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=BATCH, row_groups=[partition.row_group], columns=self.names)


class RowGroups(DataSource):
    @classmethod
    def name(cls):
        return "row_groups"

    def _arrow(self) -> tuple[pa.Schema, pa.Schema]:
        """What is read, and all that the files hold."""
        fs, _ = opened(self.options["path"])
        with fs.open_input_file(parquet_files(self.options["path"])[0]) as f:
            found = pq.read_schema(f).remove_metadata()
        names = self.options["columns"].split(",") if "columns" in self.options else found.names
        return pa.schema([found.field(n) for n in names]), found

    def schema(self):
        return from_arrow_schema(self._arrow()[0])

    def reader(self, schema):
        return RowGroupReader(dict(self.options), *self._arrow())


def row_groups(spark: SparkSession, path: str, columns: list[str] | None = None, where: list[tuple] | None = None, keys: list[str] | None = None, expected: int | None = None, most_bytes: int | None = None, index: str | None = None) -> DataFrame:
    """The rows of Parquet files that meet all conditions where(column, operator, value), a task a row group that may hold any.

    Operators: = in > >= < <=; values are numbers or texts (an ISO text for a date or time). Conditions may name columns that
    aren't read; these choose row groups only. expected: the number of distinct values of keys, each constant in its row groups,
    that must be left; most_bytes: of the columns read; index: the path of a footer_index(). Either gate is an error at planning.
    """
    spark.dataSource.register(RowGroups)
    given = {"columns": ",".join(columns) if columns else None, "where": json.dumps(where) if where else None, "keys": ",".join(keys) if keys else None, "expected": expected, "most_bytes": most_bytes, "index": index}
    df = spark.read.format("row_groups").options(**{k: str(v) for k, v in given.items() if v is not None}).load(path)
    for name, op, value in where or []:
        df = df.filter(COLUMNS[op](F.col(name), value)) if name in df.columns else df
    return df


def footer_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """file, row_group, rows, bytes, limits (JSON of smallest and largest values) of all row groups below a path: a task a file, for the index option."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                groups = footer(opened(path)[0], file, columns)
                yield pa.RecordBatch.from_pydict({"file": [file] * len(groups), "row_group": pa.array([g.row_group for g in groups], pa.int32()), "rows": pa.array([g.rows for g in groups], pa.int64()), "bytes": pa.array([g.bytes for g in groups], pa.int64()), "limits": [json.dumps([g.low, g.high], default=str) for g in groups]})

    files = parquet_files(path)
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return names.mapInArrow(run, "file string, row_group int, rows bigint, bytes bigint, limits string")


def from_index(path: str) -> list[Group]:
    """The row groups of an index; limits that aren't JSON numbers or texts compare as texts do."""
    fs, at = opened(path)
    rows = pa.concat_tables([pq.read_table(f, filesystem=fs) for f in parquet_files(path)]).to_pylist()
    return sorted((Group(r["file"], r["row_group"], r["rows"], r["bytes"], *json.loads(r["limits"])) for r in rows), key=lambda g: (g.file, g.row_group))
