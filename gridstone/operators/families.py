"""Representations of cells against a frozen span: coarse, residual, and both; and what an oracle can't reach.

A frozen basis(axis, feature, weight) has orthonormal axes. The parts of a long table along
it and beside it are sums and joins; training-only axes of either part come from `subspace`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio
from ..sources.facts import stored
from . import subspace

FAMILIES = ("full", "pca", "span", "coarse_plus_residual", "residual_only")


def orthonormal(basis: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """basis, or an error where its axes aren't orthonormal. The axes are few: their Gram is axes by axes."""
    a, b = (basis.select(F.col("axis").alias(k), "feature", F.col("weight").alias(f"w{k}")) for k in "ab")
    gram = a.join(b, "feature").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("g"))
    off = gram.filter(F.abs(F.col("g") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)) > tolerance).limit(1).collect()
    if off:
        raise ValueError(f"axes {off[0].a} and {off[0].b} have the product {off[0].g}")
    return basis


def coarse(df: DataFrame, unit: list[str], basis: DataFrame) -> DataFrame:
    """unit, axis, score."""
    return df.join(basis, "feature").groupBy(*unit, "axis").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def split(df: DataFrame, unit: list[str], basis: DataFrame) -> DataFrame:
    """df(unit, feature, value) with along, its part in the span, and beside, the rest. A feature without a weight is all beside."""
    back = coarse(df, unit, basis).join(basis, "axis").groupBy(*unit, "feature").agg(F.sum(F.col("score") * F.col("weight")).alias("along"))
    out = df.join(back, [*unit, "feature"], "left").withColumn("along", F.coalesce("along", F.lit(0.0)))
    return out.withColumn("beside", F.col("value") - F.col("along"))


def energy_split(df: DataFrame, unit: list[str], basis: DataFrame, by: list[str]) -> DataFrame:
    """by -> energy, that along the span, that beside it, and the share along; along and beside add up to all."""
    sq = lambda c: F.sum(F.col(c) * F.col(c))
    e = split(df, unit, basis).groupBy(*by).agg(sq("value").alias("energy"), sq("along").alias("along"), sq("beside").alias("beside"))
    return e.withColumn("share", safe_ratio(F.col("along"), F.col("energy")))


def representation(df: DataFrame, unit: list[str], train: DataFrame, basis: DataFrame, family: str, dims: int = 0) -> DataFrame:
    """unit, x array<double>: a family of FAMILIES, for every unit.

    train(unit): the units whose rows fit the means and the axes; no other row enters a fit. pca, coarse_plus_residual and
    residual_only have dims axes of the values or of what is beside the span; with dims 0 coarse_plus_residual is span.
    """
    if family not in FAMILIES:
        raise ValueError(f"{family} is none of {FAMILIES}")
    if family == "full":
        return subspace.packed_rows(df, unit, ["feature"], "value")
    scores = lambda: subspace.packed_rows(coarse(df, unit, basis), unit, ["axis"], "score")
    if family == "span" or (family == "coarse_plus_residual" and dims == 0):
        return scores()
    part = df if family == "pca" else split(df, unit, basis).select(*unit, "feature", F.col("beside").alias("value"))
    rows = stored(subspace.packed_rows(part, unit, ["feature"], "value"), "family-rows")  # read once a pass
    axes = subspace.fit_axes(rows.join(train.select(*unit).distinct(), unit, "left_semi"), dims)
    out = subspace.project(rows, axes).select(*unit, F.col("scores").alias("x"))
    if family != "coarse_plus_residual":
        return out
    return scores().join(out.withColumnRenamed("x", "__r"), unit).select(*unit, F.concat("x", "__r").alias("x"))


def shared_axis_removal(df: DataFrame, unit: list[str], train: DataFrame, ranks: list[int]) -> DataFrame:
    """rank, unit, feature, value, residual: what is left of every unit after the leading training axes, for each rank."""
    names = subspace.packed_rows(df.select("feature").distinct().withColumn("one", F.lit(1)), ["one"], ["feature"], "feature").select(F.col("x").alias("__names"))
    rows = stored(subspace.packed_rows(df, unit, ["feature"], "value"), "family-rows")
    axes = subspace.fit_axes(rows.join(train.select(*unit).distinct(), unit, "left_semi"), max(ranks))
    parts = []
    for r in ranks:
        cut = subspace.Axes(axes.components[:r], axes.mean, axes.energy[:r], axes.total, axes.rows)
        left = subspace.residual(rows.withColumn("__x", F.col("x")), cut)
        each = left.join(F.broadcast(names)).select(*unit, F.explode(F.arrays_zip("__names", "__x", F.col("x").alias("__r"))).alias("z"))  # one row of names
        parts.append(each.select(F.lit(r).alias("rank"), *unit, F.col("z.__names").alias("feature"), F.col("z.__x").alias("value"), F.col("z.__r").alias("residual")))
    return reduce(DataFrame.unionByName, parts)


def oracle_residual(gram: DataFrame, rcond: float = 1e-10) -> DataFrame:
    """context, references, energy, residual, share: each context's energy about the mean of all others, and what of it no weighting of them can reach.

    gram(ctx_a, ctx_b, dot): everything follows from products. The centre is that of the references alone. A task holds one
    context's Gram, an axis of the design.
    """
    held = gram.select(F.col("ctx_a").alias("context")).distinct()
    pairs = held.join(F.broadcast(gram))  # contexts by the square of contexts

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="ctx_a", columns="ctx_b", values="dot").sort_index().sort_index(axis=1)
        names = list(m.index)
        g, t = m.to_numpy(float), names.index(key[0])
        o = np.array([k for k in range(len(names)) if k != t])
        mean = np.zeros(len(names))
        mean[o] = 1 / len(o)
        shift = np.eye(len(names)) - mean  # rows less the references' mean
        c = shift @ g @ shift.T
        values, vectors = np.linalg.eigh(c[np.ix_(o, o)])
        keep = values > rcond * max(values.max(), 1e-300)
        along = (((vectors[:, keep].T @ c[o, t]) ** 2) / values[keep]).sum()
        left = max(float(c[t, t] - along), 0.0)
        return pd.DataFrame({"context": [key[0]], "references": [len(o)], "energy": [float(c[t, t])], "residual": [left], "share": [left / c[t, t] if c[t, t] > 0 else None]})

    return pairs.groupBy("context").applyInPandas(run, "context string, references int, energy double, residual double, share double")


def subset_fidelity(signal: DataFrame, full: DataFrame) -> DataFrame:
    """mask, axes, s, e, f, g, u of every non-empty set of axes of signal(axis, s, e), by full(s): orthonormal axes' energies add up.

    f = s / full, g = 1 - e / s, u = (s - e) / full. Axes are few (20 at most): sets are 2 ** axes rows.
    """
    from .design import subsets
    from .interaction import fgu

    n = signal.count()
    if n > 20:
        raise ValueError(f"{n} axes have too many sets")
    held = signal.agg(F.sort_array(F.collect_list(F.struct("axis", "s", "e"))).alias("x"))
    add = lambda name: F.aggregate("items", F.lit(0.0), lambda a, i: a + F.get(F.col("x"), i)[name])
    sets = subsets(signal.sparkSession, n).join(F.broadcast(held)).join(F.broadcast(full.select(F.col("s").alias("full"))))  # one row each
    out = sets.select("mask", F.transform("items", lambda i: F.get(F.col("x"), i)["axis"]).alias("axes"), add("s").alias("s"), add("e").alias("e"), "full")
    return out.select("mask", "axes", "s", "e", *(c.alias(k) for k, c in fgu(F.col("s"), F.col("e"), F.col("full")).items()))


def shuffled_bases(basis: DataFrame, draws: int, seed: str) -> DataFrame:
    """draw, axis, feature, weight: bases of the same sparsity and weights, features dealt anew among them in each draw; draw -1 is the basis itself."""
    from .nulls import permutation

    moved = permutation(basis.select("feature").distinct(), "feature", draws, seed).join(basis, "feature").select("draw", "axis", F.col("other").alias("feature"), "weight")
    return moved.unionByName(basis.select(F.lit(-1).alias("draw"), "axis", "feature", "weight"))


def shares_along(df: DataFrame, unit: list[str], bases: DataFrame) -> DataFrame:
    """draw, share: how much of the energy of df(unit, feature, value) lies along each draw's orthonormal basis(draw, axis, feature, weight)."""
    score = df.join(bases, "feature").groupBy("draw", *unit, "axis").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    along = score.groupBy("draw").agg(F.sum(F.col("s") * F.col("s")).alias("along"))
    total = df.agg(F.sum(F.col("value") * F.col("value")).alias("total"))
    return along.join(F.broadcast(total)).select("draw", safe_ratio(F.col("along"), F.col("total")).alias("share"))  # one row


def control_summary(shares: DataFrame) -> DataFrame:
    """observed (draw -1), mean, sd, low, high of the controls, and p, the share of draws at least as large with one added."""
    from ..functions.expr import at_least

    seen = shares.filter("draw = -1").select(F.col("share").alias("observed"))
    both = shares.filter("draw >= 0").join(F.broadcast(seen))  # one row
    return both.groupBy("observed").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"), F.min("share").alias("low"), F.max("share").alias("high"), ((1 + F.count_if(at_least(F.col("share"), F.col("observed")))) / (1 + F.count(F.lit(1)))).alias("p"))
