"""What the operators share: column helpers and tables written to the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: What parts words of letters, digits and non-ASCII characters, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, op, block: int = 256) -> Column:
    """Inclusive running fold of a non-null array<bigint> by an associative op, in blocks: linear but for short appends."""
    empty = F.expr("cast(array() as array<bigint>)")

    def fold(xs: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.element_at(acc, -1), x))))
        return F.aggregate(xs, empty, step)

    def blocks(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda c: fold(F.slice(xs, c * block + 1, block)))
        return let(parts, lambda ps: let(fold(F.transform(ps, lambda p: F.element_at(p, -1))), lambda tops: F.flatten(F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: op(F.get(tops, i - 1), x)))))))

    return F.when(F.size(values) == 0, empty).when(F.size(values) <= block, fold(values)).otherwise(blocks(values))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. Filters and projections above don't copy the expressions, as they don't pass a generator."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(made)))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """A text with A-Z, and nothing else, in lower case. Of a pure ASCII text lower() says the same sooner."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def plain_words(text: Column) -> Column:
    """The words of a text between GAPs, A-Z in lower case; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset a temporary one serves a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/gridstone/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, path)


@contextmanager
def arrow_batches(spark: SparkSession, mb: int) -> Iterator[None]:
    """Inside, no Arrow batch of a job that is run holds much over so many MB, or more than the session allows. A batch lies in memory twice, beside the JVM's heap and in the Python worker, for each core; by rows alone it is as large as its texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before), mb << 20)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
