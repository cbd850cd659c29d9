"""File sources and sinks in Spark's own readers and writers."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """CSV or TSV, plain or gzipped, with a stated schema; only the columns asked for are parsed."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return df.select(*columns) if columns else df


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """term, member of a GMT file: term, url and members, tab-separated."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(parts) > 2).select(parts[0].alias("term"), F.explode(F.slice(parts, 3, F.size(parts) - 2)).alias("member")).filter("member <> ''")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of one coordinate matrix file; the size line is the first after the comments. Lines are told apart by their place, which the numbering keeps within one file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).filter(~F.col("value").startswith("%"))
    size = lines.agg(F.min("at").alias("size_at"))
    p = F.split(F.trim("value"), r"\s+")
    return lines.join(F.broadcast(size)).filter("at > size_at").select(p[0].cast("bigint").alias("row"), p[1].cast("bigint").alias("col"), p[2].cast("double").alias("value"))


def soft_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample, key, value of a SOFT file: records begin at ^SAMPLE, fields are '!key = value' lines."""
    records = spark.read.option("lineSep", "^SAMPLE = ").text(path).filter(F.col("value").contains("!Sample_"))
    lines = records.select(F.substring_index("value", "\n", 1).alias("sample"), F.explode(F.split("value", "\n")).alias("line"))
    pattern = r"^!([^=]+?)\s*=\s*(.*)$"
    return lines.filter(F.col("line").rlike(pattern)).select(F.trim("sample").alias("sample"), F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))


def wide_matrix(spark: SparkSession, path: str, key: str, sep: str = "\t") -> DataFrame:
    """key, column, value of a wide table whose header names the cells."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.unpivot([key], [c for c in df.columns if c != key], "column", "value").withColumn("value", F.col("value").cast("double"))


def digests(files: DataFrame) -> DataFrame:
    """path, name, bytes, sha256 of files(path): read in stretches, so that a file may be of any size. Paths must be readable by pyarrow from the executors."""

    def run(batches):
        from .rowgroups import opened

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                fs, at = opened(path)
                h, size = hashlib.sha256(), 0
                with fs.open_input_stream(at) as f:
                    while part := f.read(1 << 22):
                        h.update(part)
                        size += len(part)
                rows.append({"path": path, "name": os.path.basename(path), "bytes": size, "sha256": h.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return files.select("path").mapInArrow(run, "path string, name string, bytes bigint, sha256 string")


def _listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path of every file below a folder whose name fits, empty ones too, some to a task."""
    from .rowgroups import opened

    fs, at = opened(path)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    prefix = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return spark.createDataFrame([(prefix + f,) for f in found], "path string").repartition(max(1, min(len(found), 200)))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file below a path."""
    return digests(_listed(spark, path)).select("name", "bytes", "sha256")


def save_response(df: DataFrame, path: str) -> None:
    """The fact as zstd Parquet, a folder a replicate."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("replicate").parquet(path)


def save_table(df: DataFrame, path: str) -> None:
    """A result table as CSV files with a header each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def missing_keys(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed extraction still has to do; keys are compared without outer white space."""
    trim = lambda df: df.select(*(F.trim(k).alias(k) for k in keys)).distinct()
    return trim(wanted).join(trim(done), keys, "left_anti")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])




def series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """key, values of the '!' header lines; and row, column, value of the tab-separated body, whose first line names the columns."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    parts = F.transform(F.split("value", "\t"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    header = lines.filter(F.col("value").startswith("!")).select(F.regexp_replace(parts[0], "^!", "").alias("key"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("values"))
    body = lines.filter(~F.col("value").startswith("!") & (F.trim("value") != "")).select("at", parts.alias("p"))
    names = body.agg(F.min_by("p", "at").alias("names"), F.min("at").alias("top"))
    cells = body.join(F.broadcast(names)).filter("at > top").select(F.col("p")[0].alias("row"), "p", F.posexplode("names").alias("i", "column")).filter("i > 0")
    return header, cells.select("row", "column", F.expr("try_cast(get(p, i) as double)").alias("value"))


def constant_row_groups(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """file, row_group, rows, bytes, constant, and the key columns of each row group of Parquet files, from footers only.

    A column whose smallest and largest value are equal (and which has no nulls) is constant and gives its value as text, else null.
    One task a file reads a footer; paths must be readable by pyarrow from the executors.
    """

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                meta = pq.ParquetFile(path).metadata
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    stats = [group.column(at[c]).statistics if c in at else None for c in columns]
                    same = [s is not None and s.has_min_max and s.min == s.max and not s.null_count for s in stats]
                    rows.append({"file": path, "row_group": g, "rows": group.num_rows, "bytes": group.total_byte_size, "constant": all(same)} | {c: str(s.min) if ok else None for c, s, ok in zip(columns, stats, same)})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64()), ("constant", pa.bool_()), *((c, pa.string()) for c in columns)]))

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return names.mapInArrow(run, "file string, row_group int, rows bigint, bytes bigint, constant boolean, " + ", ".join(f"{c} string" for c in columns))


def selected_groups(groups: DataFrame, wanted: DataFrame, keys: list[str], expected: int, most_bytes: int) -> DataFrame:
    """The row groups of wanted keys, behind two gates: an error where other than the expected number of keys is found or more bytes would be read."""
    found = groups.join(wanted.select(*keys).distinct(), keys, "left_semi")
    n, size = found.agg(F.count_distinct(*keys), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n != expected or size > most_bytes:
        raise ValueError(f"{n} of {expected} conditions, {size} of at most {most_bytes} bytes")
    return found


def manifests(spark: SparkSession, pattern: str, key: str) -> DataFrame:
    """The union of all CSV manifests of a pattern, with the file that each row comes from; an error where a key repeats."""
    df = spark.read.option("header", True).csv(pattern).withColumn("manifest", F.col("_metadata.file_path"))
    twice = df.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} isn't unique: {[r[0] for r in twice]}")
    return df


def protocol(path: str, required: list[str]) -> dict:
    """A JSON protocol; an error where a required entry is missing."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if lost := [k for k in required if k not in found]:
        raise KeyError(f"{path} lacks {lost}")
    return found


def write_json(path: str, value) -> None:
    """JSON by a file beside it that is renamed, so that no reader sees a part."""
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.part", path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a CSV folder; every file has the header, and reading the folder gives all rows."""
    df.write.mode("append").option("header", True).csv(path)


def save_draws(df: DataFrame, path: str) -> None:
    """A table of draws, clustered by draw, so that a reader of some draws skips the rest."""
    df.repartitionByRange("draw").sortWithinPartitions("draw").write.mode("overwrite").option("compression", "zstd").parquet(path)


def output_manifest(spark: SparkSession, folder: str, pattern: str, path: str) -> None:
    """Name, size and SHA-256 of the files of a folder, written as JSON."""
    rows = digests(_listed(spark, folder, pattern)).orderBy("path").collect()  # a row a file of results
    write_json(path, {"files": [{"name": r.name, "bytes": r.bytes, "sha256": r.sha256} for r in rows]})
