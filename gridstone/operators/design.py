"""Splits, folds and design tables, all from hashes of names and seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def hash_order(name: str, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(name).cast("string")), 256)


def stride_folds(units: DataFrame, name: str, seed: str, folds: int = 5) -> DataFrame:
    """Sorted by hash, every folds-th unit into one fold. Units are an axis of the design, not rows of the fact."""
    return units.select(name).distinct().withColumn("fold", ((F.row_number().over(Window.orderBy(hash_order(name, seed))) - 1) % folds).cast("int"))


def contiguous_folds(units: DataFrame, name: str, seed: str, folds: int = 5) -> DataFrame:
    """Sorted by hash and cut into runs; the first n % folds runs have one more."""
    df = units.select(name).distinct()
    df = df.withColumn("i", F.row_number().over(Window.orderBy(hash_order(name, seed))) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    size, more = F.floor(F.col("n") / folds), F.col("n") % folds
    cut = more * (size + 1)
    fold = F.when(F.col("i") < cut, F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - cut) / F.greatest(size, F.lit(1))))
    return df.select(name, fold.cast("int").alias("fold"))


def stratified_folds(rows: DataFrame, key: str, label: str, seed: str, folds: int = 5) -> DataFrame:
    """Folds by hash rank within each label, and the calibration fold after each."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(key, seed), F.col(key)))
    return rows.select(key, label).withColumn("fold", ((rank - 1) % folds).cast("int")).withColumn("calibration", ((F.col("fold") + 1) % folds).cast("int"))


def leave_one_out(units: DataFrame, name: str) -> DataFrame:
    """held, unit, role for every pair of an axis's units."""
    u = units.select(F.col(name).alias("unit")).distinct()
    return u.withColumnRenamed("unit", "held").crossJoin(u).withColumn("role", F.when(F.col("held") == F.col("unit"), "outer_test").otherwise("outer_train"))


def support_ladder(units: DataFrame, name: str, sequences: int, rungs: list[int]) -> DataFrame:
    """held, sequence, rung, unit: nested supports; a smaller rung is a prefix of a larger one."""
    u = units.select(F.col(name).alias("unit")).distinct()
    pairs = u.withColumnRenamed("unit", "held").join(u, F.col("held") != F.col("unit")).crossJoin(units.sparkSession.range(sequences).select(F.col("id").cast("int").alias("sequence")))
    rank = F.row_number().over(Window.partitionBy("held", "sequence").orderBy(F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "held", "unit"), 256)))
    return pairs.withColumn("rank", rank).withColumn("rung", F.explode(F.array(*map(F.lit, rungs)))).filter("rank <= rung").select("held", "sequence", "rung", "unit")


def latin_masks(df: DataFrame, folds: int = 5, step: int = 2) -> DataFrame:
    """(b + step * a) mod folds over the ranks of contexts and interventions: every entry is held out once."""
    rank = lambda c: df.select(c).distinct().withColumn(f"{c}_rank", F.row_number().over(Window.orderBy(c)) - 1)
    pairs = df.select("context", "intervention").distinct().join(rank("context"), "context").join(rank("intervention"), "intervention")
    return pairs.select("context", "intervention", F.pmod(F.col("intervention_rank") + step * F.col("context_rank"), F.lit(folds)).cast("int").alias("fold"))


def derangement(units: DataFrame, name: str, seed: str) -> DataFrame:
    """Each unit's partner: the next in hash order, the last one's being the first."""
    w = Window.orderBy(hash_order(name, seed))
    u = units.select(name).distinct()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return u.select(name, F.coalesce(F.lead(name).over(w), F.first(name).over(whole)).alias("partner"))


def shuffle_within(df: DataFrame, key: str, block: str, value: str, seed: str) -> DataFrame:
    """The block's values dealt anew to its keys: rank by key meets rank by hash."""
    a = df.withColumn("__i", F.row_number().over(Window.partitionBy(block).orderBy(key))).select(block, "__i", key, value)
    b = df.withColumn("__i", F.row_number().over(Window.partitionBy(block).orderBy(hash_order(key, seed), F.col(key)))).select(block, "__i", F.col(value).alias("shuffled"))
    return a.join(b, [block, "__i"]).drop("__i")


def quantile_bins(df: DataFrame, value: str, tie: str, bins: int, by: list[str]) -> DataFrame:
    """floor(i * bins / n) over the stable order: sizes differ by one at most."""
    w = Window.partitionBy(*by)
    return df.withColumn("bin", F.floor((F.row_number().over(w.orderBy(value, tie)) - 1) * bins / F.count(F.lit(1)).over(w)).cast("int"))


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """Exactly n rows, by hash order: partial top-n in each partition."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def subsets(spark, size: int) -> DataFrame:
    """Every non-empty subset of size items: mask and its items."""
    items = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
    return spark.range(1, 1 << size).select(F.col("id").alias("mask")).withColumn("items", items)


def leaks(splits: list[DataFrame], key: str) -> DataFrame:
    """Keys that are in more than one of the splits; none if they are disjoint."""
    tagged = reduce(DataFrame.unionByName, (s.select(key).distinct().withColumn("part", F.lit(k)) for k, s in enumerate(splits)))
    return tagged.groupBy(key).agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")


def compress_ranges(df: DataFrame, value: str) -> DataFrame:
    """Runs of consecutive integers as first, last."""
    d = numbered(df.select(F.col(value).alias("v")).filter("v is not null").distinct(), F.col("v").asc())
    return d.withColumn("g", F.col("v") - F.col("place")).groupBy("g").agg(F.min("v").alias("first"), F.max("v").alias("last")).select("first", "last")


def benchmark_targets(units: DataFrame, name: str, seed: str) -> DataFrame:
    """The units at the first, third, two-thirds and last place of the hash order."""
    df = units.select(name).distinct().withColumn("i", F.row_number().over(Window.orderBy(hash_order(name, seed))) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    n = F.col("n")
    return df.filter(F.col("i").isin(0) | (F.col("i") == F.floor(n / 3)) | (F.col("i") == F.floor(2 * n / 3)) | (F.col("i") == n - 1)).select(name, F.col("i").cast("int").alias("place"))


def two_versions(df: DataFrame, unit: str, kind: str, version: str) -> DataFrame:
    """unit, version_a, version_b: the first two versions that all kinds of the unit share."""
    kinds = df.groupBy(unit).agg(F.count_distinct(kind).alias("kinds"))
    shared = df.groupBy(unit, version).agg(F.count_distinct(kind).alias("have")).join(kinds, unit).filter("have = kinds")
    first = shared.groupBy(unit).agg(F.array_sort(F.collect_set(version)).alias("vs")).filter(F.size("vs") >= 2)
    return first.select(unit, F.col("vs")[0].alias("version_a"), F.col("vs")[1].alias("version_b"))
