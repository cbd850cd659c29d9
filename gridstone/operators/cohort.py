"""Cohort construction: screens, coverage, matched controls, joins with contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio
from .ranks import quantiles


def coverage(df: DataFrame, keys: list[str], unit: str, measure: str, flag: Column) -> DataFrame:
    """Rows, distinct units, sum, min, median, mean flag, any and all of the flag by keys; a null key is a group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(unit).alias("units"), F.sum(measure).alias("total"), F.min(measure).alias("low"), F.median(measure).alias("mid"),
        F.avg(flag.cast("double")).alias("share"), F.bool_or(flag).alias("any_flag"), F.bool_and(flag).alias("all_flag"), F.count_if(flag).alias("flagged"),
    )


def covered(df: DataFrame, unit: str, axis: str, least: int) -> DataFrame:
    """Units found in at least so many values of an axis."""
    return df.groupBy(unit).agg(F.count_distinct(axis).alias("axes")).filter(F.col("axes") >= least)


def exclude_ambiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is found once: of duplicates no copy stays."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")
    return df.join(once, keys, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest order of each key, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join whose right side must hold each key once and cover every left key: else the query fails."""
    right = right.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(c) for c in right.columns if c != key))
    out = left.join(right, key, "left")
    said = F.when(F.col("__n").isNull(), F.raise_error(F.lit("unmapped key"))).when(F.col("__n") > 1, F.raise_error(F.lit("repeated key")))
    return out.withColumn("__n", F.coalesce(said.cast("bigint"), F.col("__n"))).filter("__n = 1").drop("__n")


def outer_match(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join with a match indicator and the absolute difference of a value."""
    x, y = a.select(key, F.col(value).alias("left_value")), b.select(F.col(key).alias("__k"), F.col(value).alias("right_value"))
    side = F.when(F.col(key).isNull(), "right_only").when(F.col("__k").isNull(), "left_only").otherwise("both")
    return x.join(y, F.col(key) == F.col("__k"), "full_outer").select(F.coalesce(key, "__k").alias(key), side.alias("side"), F.abs(F.col("left_value") - F.col("right_value")).alias("gap"))


def matched_control_weights(df: DataFrame, keys: list[str], is_target: Column, unit: str) -> DataFrame:
    """unit, row, weight: +1 for a target row, -1/n for each of the n controls of its key, summed by row; weights of a unit sum to 0."""
    target = df.filter(is_target).select(*keys, F.col(unit).alias("unit"), "row")
    control = df.filter(~is_target).select(*keys, F.col("row").alias("control"))
    size = control.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_control"))
    matched = target.join(size, keys)
    minus = matched.groupBy("unit", *keys).agg((-F.count(F.lit(1)) / F.first("n_control")).alias("w")).join(control, keys).select("unit", F.col("control").alias("row"), "w")
    plus = matched.select("unit", "row", F.lit(1.0).alias("w"))
    return plus.unionByName(minus).groupBy("unit", "row").agg(F.sum("w").alias("weight"))


def log_cpm(counts: DataFrame, sample: str, feature: str, scale: float = 1e6) -> DataFrame:
    """log1p and log2(x + 1) of counts per scale; library sizes are over all features."""
    total = counts.groupBy(sample).agg(F.sum("n").alias("library"))
    cpm = safe_ratio(F.col("n") * F.lit(scale), F.col("library"))
    return counts.join(total, sample).select(sample, feature, F.log1p(cpm).alias("log1p_cpm"), F.log2(cpm + 1).alias("log2_cpm"))


def unit_rows(df: DataFrame, row: str) -> DataFrame:
    """Rows centred and scaled to length one; null for a constant row."""
    w = Window.partitionBy(row)
    d = F.col("value") - F.avg("value").over(w)
    df = df.withColumn("d", d)
    return df.withColumn("unit", safe_ratio(F.col("d"), F.sqrt(F.sum(F.col("d") * F.col("d")).over(w)))).drop("d")


def overlap_band(df: DataFrame, group: str, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The range that all groups' middle quantiles share: greatest low and least high quantile, exact for groups of any size."""
    q = quantiles(df.select(group, value), [group], value, [low, high])
    return q.agg(F.max(F.when(F.col("point") == low, F.col("q"))).alias("low"), F.min(F.when(F.col("point") == high, F.col("q"))).alias("high"))


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the total sum of squares, from group moments alone."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return total.select(safe_ratio(between, between + F.col("within")).alias("eta2"))


def barcode_collisions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two libraries share and the collision probability, sum of p_a * p_b."""
    p = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    return p(a, "pa").join(p(b, "pb"), key).agg(F.count(F.lit(1)).alias("shared"), F.sum(F.col("pa") * F.col("pb")).alias("collision"))


def feature_flags(df: DataFrame, feature: str, value: str, targets: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """feature, mean, variance and flags: a target, of an excluded prefix, without variance; eligible if none."""
    m = df.groupBy(feature).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    t = targets.select(F.col(feature)).distinct().withColumn("is_target", F.lit(True))
    prefixed = F.lit(False)
    for p in prefixes:
        prefixed = prefixed | F.upper(feature).startswith(p.upper())
    m = m.join(t, feature, "left").withColumn("is_target", F.coalesce("is_target", F.lit(False))).withColumn("is_technical", prefixed).withColumn("is_flat", F.col("variance") <= 1e-12)
    return m.withColumn("eligible", ~(F.col("is_target") | F.col("is_technical") | F.col("is_flat")))


def pairing(df: DataFrame, unit: str, kind: str, first: str, second: str) -> DataFrame:
    """unit, n_first, n_second, pairing: whether both kinds are there, once or more often."""
    n = df.groupBy(unit).agg(F.count_if(F.col(kind) == first).alias("n_first"), F.count_if(F.col(kind) == second).alias("n_second"))
    a, b = F.col("n_first"), F.col("n_second")
    return n.withColumn("pairing", F.when((a == 1) & (b == 1), "paired").when((a > 0) & (b > 0), "replicated").when(a > 0, "first_only").when(b > 0, "second_only").otherwise("neither"))


def one_of_each(df: DataFrame, group: list[str], key: str, seed: str) -> DataFrame:
    """One row of each group, that with the least hash."""
    return df.groupBy(*group).agg(F.min_by(key, F.struct(F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(g).cast("string") for g in group), F.col(key).cast("string")), 256), F.col(key))).alias(key))


def missingness(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, column, present, missing, share: coverage of wide columns in long form."""
    long = df.select(group, *(F.col(c).isNotNull().cast("int").alias(c) for c in columns)).unpivot([group], columns, "column", "there")
    return long.groupBy(group, "column").agg(F.sum("there").alias("present"), (F.count(F.lit(1)) - F.sum("there")).alias("missing"), F.avg("there").alias("share"))
