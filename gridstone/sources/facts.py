"""The response fact table, from star-schema tables or files.

response(replicate, context, intervention, feature, value): cell means of measures,
in long form. Dimension joins are left to the optimizer, which broadcasts what is small.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE = T.StructType([T.StructField("replicate", T.IntegerType()), T.StructField("context", T.StringType()), T.StructField("intervention", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order, customer, nation, region and part. Orders meet their customers first, so that line items are dealt by part and by order only, and end dealt by order."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return df.withColumn("replicate", (F.col("l_orderkey") % 2).cast("int"))



def measures() -> dict[str, Column]:
    return {"discount": F.col("l_discount") * 100, "price": F.col("l_extendedprice") / 1000, "quantity": F.col("l_quantity"), "tax": F.col("l_tax") * 100}


def cells(df: DataFrame, context: str = "n_name", intervention: str = "p_brand") -> DataFrame:
    """replicate, context, intervention, n and the mean of each measure."""
    keys = [F.col("replicate"), F.col(context).alias("context"), F.col(intervention).alias("intervention")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(name) for name, c in measures().items()))


def response(cell: DataFrame) -> DataFrame:
    """Cells in long form."""
    return cell.unpivot(["replicate", "context", "intervention"], sorted(measures()), "feature", "value")


_stored: dict[tuple, tuple[str, T.StructType]] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one serves a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def token() -> str:
    """A name of its own."""
    return uuid.uuid4().hex


def drop_later(spark: SparkSession, path: str) -> None:
    """Deletes a path when the driver ends."""
    _made.append((spark, path))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, dropped when the driver ends: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridstone/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop() -> None:
    for spark, path in _made:
        try:
            fs, at = _fs(spark, path)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells whether tables have been written anew: path, size and time of their files."""
    out = []
    for path in paths:
        fs, at = _fs(spark, path)
        for f in fs.listStatus(at):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written once to the shared folder for the tables of a folder as they are now; tables written anew are read anew."""
    key = (spark.sparkContext.applicationId, name, state(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]))
    if key not in _stored or not _fs(spark, _stored[key][0])[0].exists(_fs(spark, f"{_stored[key][0]}/_SUCCESS")[1]):
        made = stored(make(), name)
        _stored[key] = (_made[-1][1], made.schema)
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def stored_cells(spark: SparkSession, sf_dir: str, context: str, intervention: str) -> DataFrame:
    """The cells of the design: as many rows as the design has, whatever the tables hold. Every operator starts there, so that a plan with several branches reads the facts once."""
    return once(spark, sf_dir, f"cells-{context}-{intervention}", lambda: cells(sales(spark, sf_dir), context, intervention))


def clear_store() -> None:
    """Forgets what is stored, so that the next use reads the facts."""
    _stored.clear()


def facts(spark: SparkSession, sf_dir: str, context: str = "n_name", intervention: str = "p_brand") -> DataFrame:
    return response(stored_cells(spark, sf_dir, context, intervention))


FACT_SQL = """
sale AS (SELECT *, (l_orderkey % 2)::INT AS replicate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
cell AS (SELECT replicate, {context} AS context, {intervention} AS intervention, count(*) AS n, avg(l_discount * 100) AS discount, avg(l_extendedprice / 1000) AS price, avg(l_quantity) AS quantity, avg(l_tax * 100) AS tax
         FROM sale GROUP BY ALL),
fact AS (SELECT replicate, context, intervention, unnest(['discount', 'price', 'quantity', 'tax']) AS feature, unnest([discount, price, quantity, tax]) AS value FROM cell)
"""


def fact_sql(context: str = "n_name", intervention: str = "p_brand") -> str:
    return FACT_SQL.format(context=context, intervention=intervention).strip()
