"""Resampling and inference: draw tables by hash, bands, corrections, tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.expr import at_least, hash_uniform, safe_ratio
from ..sources.facts import stored
from .ranks import numbered


def unit_draws(units: DataFrame, name: str, draws: int, seed: str) -> DataFrame:
    """draw, unit, times: bootstrap counts of an axis. The axis is numbered once; draws are hash numbers, the same on any cluster."""
    axis = units.select(name).distinct().withColumn("__i", F.row_number().over(Window.orderBy(name)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    slots = axis.select(F.col("__i").alias("slot"), "__n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = slots.select("draw", F.floor(hash_uniform(F.lit(seed), F.col("draw"), F.col("slot")) * F.col("__n")).cast("int").alias("__i"))
    return pick.groupBy("draw", "__i").agg(F.count(F.lit(1)).alias("times")).join(axis, "__i").select("draw", name, "times")


def nested_draws(df: DataFrame, outer: str, inner: str, draws: int, seed: str) -> DataFrame:
    """draw, outer, inner, times: outer units with replacement, then inner units within each of them.

    Outer units are an axis of the design, inner ones as many as there are: these are numbered by ranges of (outer, inner), and
    what is drawn is dealt out before it is counted, so that no task holds an outer unit or counts of its own.
    """
    top = unit_draws(df, outer, draws, seed)
    axis = stored(numbered(df.select(outer, inner).distinct().filter(F.col(outer).isNotNull()), F.col(outer).asc(), F.col(inner).asc(), name="__place"), "places")
    first = axis.groupBy(outer).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    axis = axis.join(F.broadcast(first), outer).select(outer, inner, (F.col("__place") - F.col("__first")).cast("int").alias("__i"), "__n")
    slots = axis.select(outer, "__i", "__n").join(F.broadcast(top), outer).withColumn("rep", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    pick = slots.select("draw", outer, F.floor(hash_uniform(F.lit(seed), F.col("draw"), F.col(outer), F.col("rep"), F.col("__i")) * F.col("__n")).cast("int").alias("__i"))
    return pick.repartition("draw", outer, "__i").groupBy("draw", outer, "__i").agg(F.count(F.lit(1)).alias("times")).join(axis.drop("__n"), [outer, "__i"]).select("draw", outer, inner, "times")


def ratio_draws(draws: DataFrame, energies: DataFrame, keys: list[str]) -> DataFrame:
    """g of each draw: one minus the ratio of weighted sums; null where the signal isn't positive."""
    d = draws.join(energies, keys).groupBy("draw").agg(F.sum(F.col("times") * F.col("s")).alias("s"), F.sum(F.col("times") * F.col("e")).alias("e"))
    return d.select("draw", (1 - safe_ratio(F.col("e"), F.col("s"))).alias("g"))


def interval(df: DataFrame, keys: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))
    return q.select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "positive")


def simultaneous_band(draws: DataFrame, estimates: DataFrame, name: str, value: str, level: float = 0.95) -> DataFrame:
    """Estimate -/+ the level quantile of the largest |t| of a draw, times each name's standard error."""
    se = draws.groupBy(name).agg(F.stddev_samp(value).alias("se")).join(estimates, name)
    t = draws.join(se, name).groupBy("draw").agg(F.max(F.abs(safe_ratio(F.col(value) - F.col("estimate"), F.col("se")))).alias("t"))
    crit = t.agg(F.percentile("t", level).alias("crit"))
    return se.join(F.broadcast(crit)).select(name, "estimate", (F.col("estimate") - F.col("crit") * F.col("se")).alias("low"), (F.col("estimate") + F.col("crit") * F.col("se")).alias("high"))


def holm(df: DataFrame, p: str, tie: str) -> DataFrame:
    w = Window.orderBy(p, tie)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy())
    step = df.withColumn("__x", F.col(p) * (n - i + 1))
    return step.withColumn("holm", F.least(F.lit(1.0), F.max("__x").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__x")


def benjamini_hochberg(df: DataFrame, p: str, tie: str) -> DataFrame:
    w = Window.orderBy(p, tie)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy())
    step = df.withColumn("__x", F.col(p) * n / i)
    return step.withColumn("bh", F.least(F.lit(1.0), F.min("__x").over(w.rowsBetween(0, Window.unboundedFollowing)))).drop("__x")


def empirical_p(null: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(1 + draws at or above the observed) / (1 + draws)."""
    return null.join(observed, keys).groupBy(*keys).agg(((1 + F.count_if(at_least(F.col(value), F.col("observed")))) / (1 + F.count(F.lit(1)))).alias("p"))


def fieller(df: DataFrame, num: str, den: str, t: float = 1.959963984540054) -> DataFrame:
    """Ratio of means with its Fieller interval; bounded is false where the denominator isn't apart from 0."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.avg(num).alias("a"), F.avg(den).alias("b"), F.var_samp(num).alias("va"), F.var_samp(den).alias("vb"), F.covar_samp(num, den).alias("vab"))
    c = F.col
    k = F.lit(t * t) / c("n")
    qa, qb, qc = c("b") * c("b") - k * c("vb"), c("a") * c("b") - k * c("vab"), c("a") * c("a") - k * c("va")
    disc = qb * qb - qa * qc
    ok = (qa > 0) & (disc >= 0)
    return a.select((c("a") / c("b")).alias("ratio"), ok.alias("bounded"), F.when(ok, (qb - F.sqrt(disc)) / qa).alias("low"), F.when(ok, (qb + F.sqrt(disc)) / qa).alias("high"))


def dominance(df: DataFrame, group: str, value: str) -> DataFrame:
    """P(x < y) + P(x = y) / 2 for every ordered pair of groups, from counts by value."""
    g = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    a, b = g.select(F.col(group).alias("a"), F.col(value).alias("va"), F.col("n").alias("na")), g.select(F.col(group).alias("b"), F.col(value).alias("vb"), F.col("n").alias("nb"))
    w = F.when(F.col("va") < F.col("vb"), 1.0).when(F.col("va") == F.col("vb"), 0.5).otherwise(0.0)
    pairs = a.join(b, F.col("a") < F.col("b")).groupBy("a", "b")
    return pairs.agg((F.sum(w * F.col("na") * F.col("nb")) / F.sum(F.col("na") * F.col("nb"))).alias("p"))


def mid_percentile(df: DataFrame, value: Column, point: Column) -> DataFrame:
    return df.agg(((F.count_if(value < point) + 0.5 * F.count_if(value == point)) / F.count(value)).alias("percentile"))


def thresholds(curve: DataFrame, keys: list[str], k: str, retention: str, levels: list[float]) -> DataFrame:
    """The least k whose retention reaches each level; null where none does."""
    levelled = curve.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return levelled.groupBy(*keys, "level").agg(F.min(F.when(F.col(retention) >= F.col("level"), F.col(k))).alias("k"))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Of whole numbers: exact sums below 256, Stirling's series above."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    x = np.maximum(n, 255).astype(float)
    far = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 256, small[np.clip(n, 0, 255).astype(int)], far)


def _fisher(a, b, c, d, both: bool) -> pd.Series:
    """Tails of all tables at once: a step of the loop moves every table to its next count."""
    a, b, c, d = (x.to_numpy().astype(np.int64) for x in (a, b, c, d))
    n, row, col = a + b + c + d, a + b, a + c
    lf = log_factorial
    base = lf(row) + lf(n - row) + lf(col) + lf(n - col) - lf(n)
    logp = lambda k, i=slice(None): base[i] - lf(k) - lf(row[i] - k) - lf(col[i] - k) - lf(n[i] - row[i] - col[i] + k)
    low, high = np.maximum(0, row + col - n), np.minimum(row, col)
    seen, total = logp(a), np.zeros(len(a))
    k = low.copy() if both else a.copy()
    live = np.flatnonzero(k <= high)
    while len(live):
        lp = logp(k[live], live)
        total[live] += np.exp(lp) * ((lp <= seen[live] + 1e-7) if both else 1.0)
        k[live] += 1
        live = live[k[live] <= high[live]]
    return pd.Series(np.minimum(np.where((a <= low) & (not both), 1.0, total), 1.0))  # the whole distribution is 1


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided Fisher exact test of 2 x 2 tables: the hypergeometric upper tail."""
    return _fisher(a, b, c, d, False)


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact test: all tables that are no more probable than the one seen."""
    return _fisher(a, b, c, d, True)


def retention(df: DataFrame, keys: list[str], name: str, value: str, full: str) -> DataFrame:
    """Each name's value as a share of the full one's of the same keys; null where that isn't positive."""
    f = df.filter(F.col(name) == full).select(*keys, F.col(value).alias("__full"))
    return df.join(f, keys).select(*keys, name, safe_ratio(F.col(value), F.col("__full")).alias("retention"))


def selection_coherence(df: DataFrame, keys: list[str], k: str, least_share: float, widest: float) -> DataFrame:
    """Most frequent choice, its share and the quartile range, and whether both are within their limits."""
    n = df.groupBy(*keys, k).agg(F.count(F.lit(1)).alias("n"))
    mode = n.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(k)).alias("k"))).alias("m"), F.sum("n").alias("all")).select(*keys, (-F.col("m.k")).alias("mode"), (F.col("m.n") / F.col("all")).alias("share"))
    q = df.groupBy(*keys).agg(F.percentile(k, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select(*keys, (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    return mode.join(q, keys).withColumn("coherent", (F.col("share") >= least_share) & (F.col("iqr") <= widest))


def unit_metric_draws(draws: DataFrame, metrics: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """draw -> weighted mean of each unit metric: profiles stay whole, only units are drawn."""
    d = draws.join(metrics, unit)
    return d.groupBy("draw").agg(*(safe_ratio(F.sum(F.col("times") * F.col(c)), F.sum("times").cast("double")).alias(c) for c in names))
