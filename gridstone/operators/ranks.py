"""Places, running sums and ranks over whole tables, by range partitions.

A window without a partition sorts a table in one task. Here rows are dealt into ranges of
the order and written to the shared folder with their partition's number; each partition's
totals, a row a partition, give what lies before it; windows run inside partitions. Ties in
the order are met by counting distinct values first, so that no value makes a large range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import stored


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, highest: dict[str, Column] | None = None, lowest: dict[str, Column] | None = None) -> DataFrame:
    """df with sums, highest and lowest values of all rows before each one, in an order that should leave no ties (0, null and null for the first)."""
    kinds = [(n, c, F.sum) for n, c in (sums or {}).items()] + [(n, c, F.max) for n, c in (highest or {}).items()] + [(n, c, F.min) for n, c in (lowest or {}).items()]
    held = stored(df.withColumns({f"__v_{n}": c for n, c, _ in kinds}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = held.groupBy("__part").agg(*(f(f"__v_{n}").alias(f"__t_{n}") for n, _, f in kinds))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.select("__part", *(f(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n, _, f in kinds))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def both(n: str, f) -> Column:
        own, before = f(f"__v_{n}").over(inside), F.col(f"__b_{n}")
        if f is F.sum:
            return F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))
        return (F.greatest if f is F.max else F.least)(own, before)

    out = held.join(F.broadcast(parts), "__part")
    return out.select(*df.columns, *(both(n, f).alias(n) for n, _, f in kinds))


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1."""
    return running(df, list(order), {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) + 1)


def average_ranks(df: DataFrame, *values: str) -> DataFrame:
    """df with r_<value> for each value: its rank from 1, ties sharing their average; null for null. df is written first, so that what makes it runs once, whatever the number of values."""
    df = base = stored(df, "unranked")
    for v in values:
        by = base.filter(F.col(v).isNotNull()).groupBy(F.col(v).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
        by = running(by, [F.col("__value").asc()], {"__below": F.col("__n")}).select("__value", (F.col("__below") + (F.col("__n") + 1) / 2).alias(f"r_{v}"))
        df = df.join(by, F.col(v) == F.col("__value"), "left").drop("__value")
    return df


def quantiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """keys, point, q: exact quantiles with linear interpolation, groups of any size.

    Distinct values are counted by group and dealt into ranges of (group, value); running counts give each value the places
    that it takes, and the one or two values at a quantile's place are all that is kept.
    """
    by = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    total = by.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    run = running(by, [*(F.col(k).asc() for k in keys), F.col(value).asc()], {"__before": F.col("__n")})
    first = run.groupBy(*keys).agg(F.min("__before").alias("__first"))
    run = run.join(first, keys).join(total, keys).withColumn("point", F.explode(F.array(*map(F.lit, points))))
    at = F.col("point") * (F.col("__all") - 1)
    low, high = F.col("__before") - F.col("__first"), F.col("__before") - F.col("__first") + F.col("__n") - 1  # places of the value, from 0
    near = run.filter((low <= F.ceil(at)) & (high >= F.floor(at)))
    pick = lambda place: F.max(F.when((low <= place) & (high >= place), F.col(value)))
    out = near.groupBy(*keys, "point").agg(pick(F.floor(at)).alias("__a"), pick(F.ceil(at)).alias("__b"), F.first(at).alias("__at"))
    return out.select(*keys, "point", (F.col("__a") + (F.col("__at") - F.floor("__at")) * (F.col("__b") - F.col("__a"))).alias("q"))


def weighted_ranks(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """df with name: the average rank of a value among the rows of its keys, each row as often as its weight says."""
    by = df.groupBy(*keys, F.col(value).alias("__value")).agg(F.sum(weight).alias("__n"))
    run = running(by, [*(F.col(k).asc() for k in keys), F.col("__value").asc()], {"__before": F.col("__n")})
    first = run.groupBy(*keys).agg(F.min("__before").alias("__first"))
    at = run.join(first, keys).select(*keys, "__value", (F.col("__before") - F.col("__first") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(at.withColumnRenamed("__value", value), [*keys, value])
