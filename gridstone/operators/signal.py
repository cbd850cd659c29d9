"""Reliable energies, donor-disjoint distances and permutation nulls over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio
from .design import hash_order


def reliable_shares(halves: DataFrame, components: list[str]) -> DataFrame:
    """component, energy, share: products of two independent halves' components, negative sums set to 0, as shares of their total.

    halves has name0 and name1 for each component. One pass: every component is a sum.
    """
    sums = halves.agg(*(F.greatest(F.sum(F.col(f"{c}0") * F.col(f"{c}1")), F.lit(0.0)).alias(c) for c in components))
    long = sums.unpivot([], components, "component", "energy")
    return long.withColumn("share", safe_ratio(F.col("energy"), F.sum("energy").over(Window.partitionBy())))


def half_partitions(spark, donors: list[str]) -> DataFrame:
    """partition, donor, half: the three balanced splits of four donors into two and two."""
    first, *rest = donors
    rows = [(p, d, int(d not in (first, rest[p]))) for p in range(3) for d in donors]
    return spark.createDataFrame(rows, "partition int, donor string, half int")


def disjoint_distances(df: DataFrame, partitions: DataFrame) -> DataFrame:
    """partition, intervention, state_a < state_b -> products of state differences between donor-disjoint halves, centred over interventions, averaged over features.

    df(donor, state, intervention, feature, value).
    """
    half = df.join(F.broadcast(partitions), "donor").groupBy("partition", "half", "intervention", "state", "feature").agg(F.avg("value").alias("v"))
    a, b = (half.select("partition", "half", "intervention", "feature", F.col("state").alias(f"state_{k}"), F.col("v").alias(f"v{k}")) for k in "ab")
    diff = a.join(b, ["partition", "half", "intervention", "feature"]).filter("state_a < state_b").withColumn("d", F.col("va") - F.col("vb"))
    mean = diff.groupBy("partition", "half", "feature", "state_a", "state_b").agg(F.avg("d").alias("m"))
    diff = diff.join(mean, ["partition", "half", "feature", "state_a", "state_b"]).withColumn("d", F.col("d") - F.col("m"))
    keys = ["partition", "intervention", "feature", "state_a", "state_b"]
    left, right = (diff.filter(F.col("half") == k).select(*keys, F.col("d").alias(f"d{k}")) for k in (0, 1))
    return left.join(right, keys).groupBy("partition", "intervention", "state_a", "state_b").agg(F.avg(F.col("d0") * F.col("d1")).alias("distance"))


def distance_summary(distances: DataFrame) -> DataFrame:
    """Mean, median and positive share by pair of states, and in how many partitions the mean is positive."""
    each = distances.groupBy("state_a", "state_b", "partition").agg(F.avg("distance").alias("m"))
    up = each.groupBy("state_a", "state_b").agg(F.count_if(F.col("m") > 0).alias("positive_partitions"))
    return distances.groupBy("state_a", "state_b").agg(F.avg("distance").alias("mean"), F.median("distance").alias("mid"), F.avg((F.col("distance") > 0).cast("double")).alias("positive")).join(up, ["state_a", "state_b"])


def context_distance(df: DataFrame, value: str = "value") -> DataFrame:
    """ctx_a < ctx_b: mean over interventions of the root mean squared difference over features."""
    a, b = (df.select("replicate", "intervention", "feature", F.col("context").alias(f"ctx_{k}"), F.col(value).alias(f"v{k}")) for k in "ab")
    d = a.join(b, ["replicate", "intervention", "feature"]).filter("ctx_a < ctx_b")
    each = d.groupBy("ctx_a", "ctx_b", "replicate", "intervention").agg(F.sqrt(F.avg((F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb")))).alias("d"))
    return each.groupBy("ctx_a", "ctx_b").agg(F.avg("d").alias("distance"))


def weighted_error(gram: DataFrame, weights: DataFrame) -> DataFrame:
    """context -> d_tt - 2 w'd + w'Dw from a context Gram and weights(context, source, weight)."""
    w = weights.select("context", F.col("source").alias("s"), F.col("weight").alias("w")).unionByName(weights.select("context").distinct().select("context", F.col("context").alias("s"), F.lit(-1.0).alias("w")))
    a, b = w.select("context", F.col("s").alias("ctx_a"), F.col("w").alias("wa")), w.select("context", F.col("s").alias("ctx_b"), F.col("w").alias("wb"))
    return a.join(b, "context").join(gram, ["ctx_a", "ctx_b"]).groupBy("context").agg(F.sum(F.col("wa") * F.col("wb") * F.col("dot")).alias("error"))


def permuted(df: DataFrame, unit: str, label: str, by: list[str], draws: int, seed: str) -> DataFrame:
    """draw, unit, label, shuffled: labels dealt anew within strata for each draw, rank by unit meeting rank by hash."""
    base = df.select(*by, unit, label).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(unit).cast("string")), 256)
    at = base.withColumn("i", F.row_number().over(Window.partitionBy("draw", *by).orderBy(unit)))
    to = base.withColumn("i", F.row_number().over(Window.partitionBy("draw", *by).orderBy(key, unit))).select("draw", *by, "i", F.col(label).alias("shuffled"))
    return at.join(to, ["draw", *by, "i"]).drop("i")


def influence(df: DataFrame, unit: str) -> DataFrame:
    """unit -> g without it, by totals less its own sums of s and e."""
    by = df.groupBy(unit).agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    w = Window.partitionBy()
    s, e = F.sum("s").over(w) - F.col("s"), F.sum("e").over(w) - F.col("e")
    return by.select(unit, (1 - safe_ratio(e, s)).alias("g_without"))


def guide_halves(df: DataFrame, guide: str, target: str, seed: str) -> DataFrame:
    """guide, target, half: guides of a target in hash order dealt to A and B in turn; targets of one guide drop out."""
    d = df.select(guide, target).distinct()
    w = Window.partitionBy(target)
    return d.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("half", F.when(F.row_number().over(w.orderBy(hash_order(guide, seed), guide)) % 2 == 1, "A").otherwise("B")).filter("n >= 2").drop("n")


def checks(*named) -> DataFrame:
    """name, passed, detail of (name, DataFrame of violations): a check passes if there are none."""
    spark = named[0][1].sparkSession
    out = None
    for name, bad in named:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" violations")).alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "name string, passed boolean, detail string")


def fold_gram(df: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, ctx_a, ctx_b -> product, sum_a, sum_b, n: pieces that add up over folds of interventions."""
    d = df.join(folds, "intervention")
    a, b = (d.select("fold", "intervention", "feature", "replicate", F.col("context").alias(f"ctx_{k}"), F.col("value").alias(f"v{k}")) for k in "ab")
    return a.join(b, ["fold", "intervention", "feature", "replicate"]).groupBy("fold", "ctx_a", "ctx_b").agg(F.sum(F.col("va") * F.col("vb")).alias("product"), F.sum("va").alias("sum_a"), F.sum("vb").alias("sum_b"), F.count(F.lit(1)).alias("n"))


def gram_without(pieces: DataFrame) -> DataFrame:
    """hidden, ctx_a, ctx_b -> centred product over all other folds: total less the fold's own pieces, no second pass."""
    w = Window.partitionBy("ctx_a", "ctx_b")
    rest = lambda c: F.sum(c).over(w) - F.col(c)
    return pieces.select(F.col("fold").alias("hidden"), "ctx_a", "ctx_b", (rest("product") - rest("sum_a") * rest("sum_b") / rest("n")).alias("dot"))


def shared_and_specific(df: DataFrame) -> DataFrame:
    """context -> beta, shared, specific: the part of its deltas along the mean of the other contexts, and the energy that is orthogonal to it."""
    from .interaction import leave_one_out_mean

    p = leave_one_out_mean(df, "replicate", "intervention", "feature")
    s = p.groupBy("context").agg(F.sum(F.col("value") * F.col("loo")).alias("vl"), F.sum(F.col("loo") * F.col("loo")).alias("ll"), F.sum(F.col("value") * F.col("value")).alias("vv"))
    beta = safe_ratio(F.col("vl"), F.col("ll"))
    return s.select("context", beta.alias("beta"), (beta * F.col("vl")).alias("shared"), (F.col("vv") - beta * F.col("vl")).alias("specific"))


def matched(df: DataFrame, pool: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """key, partner, rank: the n nearest of the pool by absolute difference, then by id. Both are small tables of summary rows."""
    p = pool.select(F.col(key).alias("partner"), F.col(value).alias("__v"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.col(value) - F.col("__v")), "partner"))
    return df.join(p, F.col(key) != F.col("partner")).withColumn("rank", rank).filter(F.col("rank") <= n).select(key, "partner", "rank")
