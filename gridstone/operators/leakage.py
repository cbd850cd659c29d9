"""Digests that tell whether anything held out reached a fit, and replay of stored predictions.

A row's digest is a number from the SHA-256 of its columns as text; a table's is the sum of
its rows' numbers, their count and a second sum, so that order and partitioning play no part
and digests of parts add up. Numbers are rounded before they are digested, as the last bits
of a sum hang on its order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def as_text(df: DataFrame, columns: list[str], digits: int = DIGITS) -> Column:
    """The columns joined as text; doubles as whole numbers of 10 ** -digits, null apart from all else."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        x = F.col(c)
        if kinds[c] in ("double", "float"):
            x = F.round(x * 10.0**digits, 0).cast("decimal(38,0)")
        return F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("~"))

    return F.concat_ws("|", *(one(c) for c in columns))


def number(text: Column, at: int) -> Column:
    """52 bits of the text's SHA-256, from a place of its hexadecimal form."""
    return F.conv(F.substring(F.sha2(text, 256), at, 13), 16, 10).cast("decimal(38,0)")


def digest(df: DataFrame, keys: list[str], columns: list[str], digits: int = DIGITS) -> DataFrame:
    """keys, rows, digest: of the columns of each key's rows, repeated rows counted."""
    text = as_text(df, columns, digits)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(number(text, 1)).alias("__a"), F.sum(number(text, 14)).alias("__b"))
    return sums.select(*keys, "rows", F.concat_ws("-", F.col("__a").cast("string"), F.col("__b").cast("string")).alias("digest"))


def visible(df: DataFrame, folds: DataFrame, unit: str) -> DataFrame:
    """df with outer: each row once for every fold that doesn't hold it out. Folds are few."""
    every = folds.select(F.col("fold").alias("outer")).distinct()
    return df.join(folds, unit).join(F.broadcast(every), F.col("fold") != F.col("outer"))


def training_digests(df: DataFrame, folds: DataFrame, unit: str, objects: dict[str, list[str]], digits: int = DIGITS) -> DataFrame:
    """outer, object, rows, digest: of each named list of columns over what the fold may see."""
    seen = visible(df, folds, unit)
    parts = [digest(seen, ["outer"], columns, digits).withColumn("object", F.lit(name)) for name, columns in objects.items()]
    return reduce(DataFrame.unionByName, parts).select("outer", "object", "rows", "digest")


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, same: whether both sides have a key with equal rows and digest; a key of one side only is not the same."""
    x = a.select(*keys, F.struct("rows", "digest").alias("__a"))
    y = b.select(*keys, F.struct("rows", "digest").alias("__b"))
    return x.join(y, keys, "full_outer").select(*keys, F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)).alias("same"))


def replay(stored: DataFrame, again: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """check, detail, passed: rows of both sides, keys of one side only, repeated keys, and the largest difference against the tolerance."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*keys).alias("d")).select(F.lit(n).alias("side"), "n", "d")
    sizes = count(stored, "stored").unionByName(count(again, "again"))
    a = stored.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__ia"))
    b = again.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__ib"))
    both = a.join(b, keys, "full_outer")
    apart = F.abs(F.col("__a") - F.col("__b"))
    odd = F.col("__a").isNull() != F.col("__b").isNull()  # null on one side only
    one = both.agg(F.count_if(F.col("__ia").isNull() | F.col("__ib").isNull()).alias("alone"), F.coalesce(F.max(apart), F.lit(0.0)).alias("worst"), F.count_if(odd & F.col("__ia").isNotNull() & F.col("__ib").isNotNull()).alias("odd"))
    rows = sizes.select(F.concat(F.col("side"), F.lit(" keys are unique")).alias("check"), (F.col("n") - F.col("d")).cast("double").alias("detail"), (F.col("n") == F.col("d")).alias("passed"))
    more = one.select(F.inline(F.array(
        F.struct(F.lit("keys on both sides").alias("check"), F.col("alone").cast("double").alias("detail"), (F.col("alone") == 0).alias("passed")),
        F.struct(F.lit("values agree").alias("check"), F.col("worst").alias("detail"), ((F.col("worst") <= tolerance) & (F.col("odd") == 0)).alias("passed")),
    )))
    return rows.unionByName(more)


def timing_gate(episodes: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], allowed: float, seed: str = "gate", tried: int = 4) -> DataFrame:
    """episode, seconds, projected, passed: a few episodes in hash order are run and timed, the slowest stands for all of them, and the projected time is held against the seconds allowed. Nothing else is run."""
    spark = episodes.sparkSession
    axis = episodes.select(key).distinct()
    first = axis.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(tried)
    names, total = [r[0] for r in first.collect()], axis.count()
    took = []
    for name in names:
        begun = time.monotonic()
        run(episodes.filter(F.col(key) == F.lit(name))).write.format("noop").mode("overwrite").save()
        took.append(time.monotonic() - begun)
    projected = max(took, default=0.0) * total
    return spark.createDataFrame([(str(n), t, projected, projected <= allowed) for n, t in zip(names, took)], "episode string, seconds double, projected double, passed boolean")
