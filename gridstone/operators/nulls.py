"""Permutation nulls, paired and crossed draws, and summaries of them.

Draws are hash numbers of (seed, draw, unit), so that they are the same on any cluster.
Permutations number the units of a block by a hash order: windows run over the units
of one draw and block, never over facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import at_least, hash_uniform, safe_ratio
from ..sources.facts import stored
from .ranks import weighted_ranks


def in_draws(df: DataFrame, draws: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def _order(seed: str, *parts: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(p).cast("string") for p in parts)), 256)


def permutation(units: DataFrame, unit: str, draws: int, seed: str, block: list[str] | None = None) -> DataFrame:
    """draw, block, unit, other: in each draw a random re-pairing of the units of a block."""
    block = block or []
    w = Window.partitionBy("draw", *block)
    df = in_draws(units.select(unit, *block).distinct(), draws)
    df = df.withColumn("__i", F.row_number().over(w.orderBy(unit))).withColumn("__j", F.row_number().over(w.orderBy(_order(seed, "draw", unit), unit)))
    other = df.select("draw", *block, F.col("__j").alias("__i"), F.col(unit).alias("other"))
    return df.drop("__j").join(other, ["draw", *block, "__i"]).select("draw", *block, unit, "other")


def shifts(units: DataFrame, unit: str) -> DataFrame:
    """shift, unit, other: the n - 1 cyclic derangements of the units, numbered in their order."""
    w = Window.orderBy(unit)
    axis = units.select(unit).distinct().withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    moved = axis.withColumn("shift", F.explode(F.sequence(F.lit(1), F.greatest(F.col("__n") - 1, F.lit(1)).cast("int"))))
    return moved.withColumn("__j", (F.col("__i") + F.col("shift")) % F.col("__n")).join(axis.select(F.col("__i").alias("__j"), F.col(unit).alias("other")), "__j").select("shift", unit, "other")


def match_null(scores: DataFrame, row: str, column: str, value: str, pairs: DataFrame, by: str) -> DataFrame:
    """by, matched: the mean score of the pairs(by, row, other) that stand for the true match in each draw or shift."""
    return pairs.join(scores, (pairs[row] == scores[row]) & (pairs["other"] == scores[column])).groupBy(by).agg(F.avg(value).alias("matched"))


def fingerprint_null(scores: DataFrame, row: str, column: str, value: str, pairs: DataFrame, by: str) -> DataFrame:
    """by -> effect (stand-in match less the row's median), top1 and top10 shares of the stand-in's rank."""
    w = Window.partitionBy(row)
    ranked = scores.withColumn("__r", F.rank().over(w.orderBy(F.col(value).desc()))).join(scores.groupBy(row).agg(F.median(value).alias("__m")), row)
    hit = pairs.join(ranked.withColumnsRenamed({row: "__row", column: "__col"}), (F.col(row) == F.col("__row")) & (F.col("other") == F.col("__col")))
    return hit.groupBy(by).agg(F.avg(F.col(value) - F.col("__m")).alias("effect"), F.avg((F.col("__r") <= 1).cast("double")).alias("top1"), F.avg((F.col("__r") <= 10).cast("double")).alias("top10"))


def permutation_mean_p(df: DataFrame, unit: str, first: Column, value: str, draws: int, seed: str) -> DataFrame:
    """Difference of means of two samples and (1 + draws as far from 0) / (1 + draws), labels permuted by hash order."""
    base = df.select(F.col(unit).alias("u"), first.alias("f"), F.col(value).alias("x"))
    seen = base.agg((F.avg(F.when(F.col("f"), F.col("x"))) - F.avg(F.when(~F.col("f"), F.col("x")))).alias("difference"), F.count_if("f").alias("n"))
    order = Window.partitionBy("draw").orderBy(_order(seed, "draw", "u"), "u")
    perm = in_draws(base, draws).withColumn("i", F.row_number().over(order)).join(F.broadcast(seen))  # one row
    d = perm.groupBy("draw").agg((F.avg(F.when(F.col("i") <= F.col("n"), F.col("x"))) - F.avg(F.when(F.col("i") > F.col("n"), F.col("x")))).alias("d"), F.first("difference").alias("difference"))
    return d.groupBy("difference").agg(((1 + F.count_if(at_least(F.abs("d"), F.abs("difference")))) / (1 + F.count(F.lit(1)))).alias("p"))


def mantel(pairs: DataFrame, a: str, b: str, x: str, y: str, draws: int, seed: str) -> DataFrame:
    """draw -> correlation of the ranks of two distance tables over a < b, one of them with its units relabelled; draw -1 is as observed."""
    units = pairs.select(F.col(a).alias("u")).unionByName(pairs.select(F.col(b).alias("u"))).distinct()
    same = units.select(F.lit(-1).alias("draw"), "u", F.col("u").alias("other"))
    p = permutation(units, "u", draws, seed).select("draw", "u", "other").unionByName(same)
    one, two = (p.select("draw", F.col("u").alias(k), F.col("other").alias(f"{k}_")) for k in (a, b))
    moved = pairs.select(a, b, y).join(one, a).join(two, ["draw", b])
    moved = moved.select("draw", F.least(f"{a}_", f"{b}_").alias(a), F.greatest(f"{a}_", f"{b}_").alias(b), F.col(y))
    both = moved.join(pairs.select(a, b, x), [a, b])
    rank = lambda c: F.rank().over(Window.partitionBy("draw").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("draw", c)) - 1) / 2
    return both.withColumn("__x", rank(x)).withColumn("__y", rank(y)).groupBy("draw").agg(F.corr("__x", "__y").alias("spearman"))


def sign_flips(df: DataFrame, unit: str, metrics: list[str], draws: int, seed: str) -> DataFrame:
    """draw -> the largest |t| of the metrics after each unit's sign has been flipped or not, studentised anew."""
    sign = F.when(hash_uniform(F.lit(seed), F.col("draw"), F.col(unit)) < 0.5, -1.0).otherwise(1.0)
    t = lambda c: F.abs(safe_ratio(F.avg(sign * F.col(c)) * F.sqrt(F.count(c).cast("double")), F.stddev_samp(sign * F.col(c))))
    return in_draws(df, draws).groupBy("draw").agg(F.greatest(*(t(c) for c in metrics), F.lit(0.0)).alias("t"))


def max_t(df: DataFrame, metrics: list[str], flips: DataFrame) -> DataFrame:
    """metric, t and its p against the flips' largest |t|."""
    t = lambda c: safe_ratio(F.avg(c) * F.sqrt(F.count(c).cast("double")), F.stddev_samp(c))
    seen = df.agg(*(t(c).alias(c) for c in metrics)).unpivot([], metrics, "metric", "seen")
    return flips.join(F.broadcast(seen)).groupBy("metric", "seen").agg(((1 + F.count_if(at_least(F.col("t"), F.abs("seen")))) / (1 + F.count(F.lit(1)))).alias("p"))  # a row a metric


def matched_random(items: DataFrame, item: str, chosen: Column, bins: list[str], draws: int, seed: str) -> DataFrame:
    """draw, item: from each joint bin as many random others as it holds chosen ones (as far as there are)."""
    df = items.withColumn("__c", chosen)
    want = df.groupBy(*bins).agg(F.count_if("__c").alias("__n"))
    order = Window.partitionBy("draw", *bins).orderBy(_order(seed, "draw", item), item)
    pool = in_draws(df.filter(~F.col("__c")).join(want, bins), draws).withColumn("__i", F.row_number().over(order))
    return pool.filter(F.col("__i") <= F.col("__n")).select("draw", item)


def random_comparator(pairs: DataFrame, unit: str, other: str, value: str, nearest: DataFrame, draws: int, seed: str) -> DataFrame:
    """Mean distance to the nearest(unit, value) and its lower-tail p against a random other unit each."""
    order = Window.partitionBy("draw", unit).orderBy(_order(seed, "draw", unit, other), other)
    null = in_draws(pairs, draws).withColumn("__i", F.row_number().over(order)).filter("__i = 1").groupBy("draw").agg(F.avg(value).alias("d"))
    seen = nearest.agg(F.avg(value).alias("observed"))
    return null.join(F.broadcast(seen)).groupBy("observed").agg(((1 + F.count_if(at_least(F.col("observed"), F.col("d")))) / (1 + F.count(F.lit(1)))).alias("p"))


def block_draws(df: DataFrame, block: list[str], unit: str, draws: int, seed: str) -> DataFrame:
    """draw, block, unit, times: in every block as many units with replacement as it has. Numbers come from the block's own key, so that a block that several groups refer to is drawn once."""
    axis = df.select(*block, unit).distinct()
    w = Window.partitionBy(*block)
    axis = axis.withColumn("__i", F.row_number().over(w.orderBy(unit)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    pick = in_draws(axis, draws).select("draw", *block, F.floor(hash_uniform(F.lit(seed), F.col("draw"), *map(F.col, block), F.col("__i")) * F.col("__n")).cast("int").alias("__i"))
    return pick.groupBy("draw", *block, "__i").agg(F.count(F.lit(1)).alias("times")).join(axis.drop("__n"), [*block, "__i"]).select("draw", *block, unit, "times")


def crossed_draws(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two axes' draws(draw, unit, times): every cell's times are those of its row and column."""
    names = [c for x in (a, b) for c in x.columns if c not in ("draw", "times")]
    return a.withColumnRenamed("times", "__a").join(b.withColumnRenamed("times", "__b"), "draw").select("draw", *names, (F.col("__a") * F.col("__b")).alias("times"))


def model_differences(draws: DataFrame, energies: DataFrame, unit: str, model: str, base: str) -> DataFrame:
    """draw, model -> g of the model less g of the base, both with the draw's weights. energies(unit, model, s, e)."""
    g = draws.join(energies, unit).groupBy("draw", model).agg((1 - safe_ratio(F.sum(F.col("times") * F.col("e")), F.sum(F.col("times") * F.col("s")))).alias("g"))
    first = g.filter(F.col(model) == base).select("draw", F.col("g").alias("__g"))
    return g.filter(F.col(model) != base).join(first, "draw").select("draw", model, (F.col("g") - F.col("__g")).alias("difference"))


def subset_medians(draws: DataFrame, energies: DataFrame, unit: str, subsets: DataFrame) -> DataFrame:
    """draw, k -> median g over the subsets(subset, k, unit) of k units."""
    g = draws.join(energies, unit).join(subsets, unit).groupBy("draw", "subset", "k").agg((1 - safe_ratio(F.sum(F.col("times") * F.col("e")), F.sum(F.col("times") * F.col("s")))).alias("g"))
    return g.groupBy("draw", "k").agg(F.median("g").alias("g"))


def weighted_correlation(df: DataFrame, keys: list[str], weight: str, x: str, y: str) -> DataFrame:
    """keys, n, r: Pearson's correlation with each row as often as its weight; null where a side is constant."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    m = df.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    c = F.col
    cov = lambda p, q, pq: c(pq) - c(p) * c(q) / c("n")
    return m.select(*keys, "n", safe_ratio(cov("sa", "sb", "ab"), F.sqrt(F.greatest(cov("sa", "sa", "aa") * cov("sb", "sb", "bb"), F.lit(0.0)))).alias("r"))


def spearman_draws(draws: DataFrame, rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """draw -> rank correlation of rows repeated as often as drawn; ties share their average rank. Ranks come from counts of distinct values dealt into ranges of (draw, value), so that no task holds a draw."""
    df = stored(draws.join(rows, keys).select("draw", "times", x, y), "drawn-rows")
    df = weighted_ranks(weighted_ranks(df, ["draw"], x, "times", "__x"), ["draw"], y, "times", "__y")
    return weighted_correlation(df, ["draw"], "times", "__x", "__y").select("draw", F.col("r").alias("spearman"))


def pair_geometry_draws(draws: DataFrame, pairs: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """draw -> mean over folds of the rank correlation of true and predicted distances of pairs(fold, a, b, x, y) of different units of one fold, each pair as often as both of its units are drawn together. Folds without spread in a draw count for nothing."""
    side = lambda k: draws.select("draw", F.col(unit).alias(k), F.col("times").alias(f"__{k}"))
    both = pairs.filter("a <> b").join(side("a"), "a").join(side("b"), ["draw", "b"]).select("draw", "fold", x, y, (F.col("__a") * F.col("__b")).alias("times"))
    df = stored(both, "drawn-pairs")
    df = weighted_ranks(weighted_ranks(df, ["draw", "fold"], x, "times", "__x"), ["draw", "fold"], y, "times", "__y")
    return weighted_correlation(df, ["draw", "fold"], "times", "__x", "__y").groupBy("draw").agg(F.avg("r").alias("geometry"))


def derangements(units: DataFrame, unit: str, draws: int, seed: str) -> DataFrame:
    """shift, unit, other: re-pairings of the units that leave none in place. All of them for five units or fewer, in the order of their pairings; else as many as draws, each a hash order in which every unit takes the place of the next."""
    axis = units.select(unit).distinct()
    n = axis.count()
    if n > 5:
        w = Window.partitionBy("shift")
        df = axis.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__i", F.row_number().over(w.orderBy(_order(seed, "shift", unit), unit)))
        nxt = df.select("shift", ((F.col("__i") + n - 2) % n + 1).alias("__i"), F.col(unit).alias("other"))
        return df.join(nxt, ["shift", "__i"]).select("shift", unit, "other")
    names = F.broadcast(axis.withColumnRenamed(unit, "__u"))  # five rows at most
    order = axis.agg(F.sort_array(F.collect_list(unit)).alias("__all"))
    paths = order.withColumn("__p", F.slice("__all", 1, 0))
    for k in range(n):
        paths = paths.join(names, ~F.array_contains("__p", F.col("__u")) & (F.col("__u") != F.get("__all", F.lit(k)))).withColumn("__p", F.array_append("__p", F.col("__u"))).drop("__u")
    paths = paths.withColumn("shift", F.row_number().over(Window.orderBy("__p")) - 1)  # 44 rows at most
    return paths.select("shift", F.explode(F.arrays_zip("__all", "__p")).alias("z")).select("shift", F.col("z.__all").alias(unit), F.col("z.__p").alias("other"))


def pair_draws(draws: DataFrame, pairs: DataFrame, unit: str, value: str) -> DataFrame:
    """draw -> mean of pairs(a, b, value) of different units, each as often as both of its units together."""
    side = lambda k: draws.select("draw", F.col(unit).alias(k), F.col("times").alias(f"__{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["draw", "b"])
    w = F.col("__a") * F.col("__b")
    return both.groupBy("draw").agg(safe_ratio(F.sum(w * F.col(value)), F.sum(w).cast("double")).alias("mean"))


def partition_mean_draws(draws: DataFrame, contributions: DataFrame, unit: str, partition: str, value: str) -> DataFrame:
    """draw -> the mean over partitions of the drawn units' mean."""
    each = draws.join(contributions, unit).groupBy("draw", partition).agg(safe_ratio(F.sum(F.col("times") * F.col(value)), F.sum("times").cast("double")).alias("m"))
    return each.groupBy("draw").agg(F.avg("m").alias("mean"))


def pooled_draws(draws: DataFrame, sums: DataFrame, unit: str, seed: str) -> DataFrame:
    """draw -> alpha, kappa, cosine of units pooled with their times, averaged over seeds. sums(unit, seed, tp, tt, pp)."""
    w = F.col("times")
    s = draws.join(sums, unit).groupBy("draw", seed).agg(*(F.sum(w * F.col(c)).alias(c) for c in ("tp", "tt", "pp")))
    t, p, x = F.col("tt"), F.col("pp"), F.col("tp")
    m = s.select("draw", safe_ratio(x, t).alias("alpha"), F.sqrt(safe_ratio(p, t)).alias("kappa"), safe_ratio(x, F.sqrt(t * p)).alias("cosine"))
    return m.groupBy("draw").agg(*(F.avg(c).alias(c) for c in ("alpha", "kappa", "cosine")))


def null_summary(null: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys -> mean, sd and 95th percentile of the null, what is observed less the mean, and the empirical p."""
    df = null.join(observed, keys)
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.percentile(v, 0.95).alias("p95"), (F.first("observed") - F.avg(v)).alias("effect"), ((1 + F.count_if(at_least(v, F.col("observed")))) / (1 + F.count(F.lit(1)))).alias("p")
    )


def lower_band(draws: DataFrame, estimates: DataFrame, name: str, value: str, level: float = 0.95, family: str | None = None) -> DataFrame:
    """One-sided simultaneous lower limits: the estimate less the level quantile of a draw's largest (estimate - draw) / se, within each family where there are any."""
    by = [family] if family else []
    se = draws.groupBy(*by, name).agg(F.stddev_samp(value).alias("se")).join(estimates, [*by, name])
    t = draws.join(se, [*by, name]).groupBy(*by, "draw").agg(F.max(safe_ratio(F.col("estimate") - F.col(value), F.col("se"))).alias("t"))
    crit = t.groupBy(*by).agg(F.percentile("t", level).alias("crit"))
    both = se.join(crit, by) if by else se.join(F.broadcast(crit))  # one row
    return both.select(*by, name, "estimate", (F.col("estimate") - F.col("crit") * F.col("se")).alias("low"))


def not_inferior(band: DataFrame, margin: float) -> DataFrame:
    return band.withColumn("passed", F.col("low") > -margin)


def residual_products(df: DataFrame, value: str, fold: Column) -> DataFrame:
    """fold, p, q: products of interventions' residuals of replicate 0 and 1 over contexts and features, inside folds of interventions. Every null draw needs these alone."""
    side = lambda k, n: df.filter(F.col("replicate") == k).select(fold.alias("fold"), "context", "feature", F.col("intervention").alias(n), F.col(value).alias(f"x{n}"))
    both = side(0, "p").join(side(1, "q"), ["fold", "context", "feature"])
    return both.groupBy("fold", "p", "q").agg(F.sum(F.col("xp") * F.col("xq")).alias("x"))


def residual_null(products: DataFrame, draws: int, seed: str) -> DataFrame:
    """draw -> the sum over interventions of their product with the one that a draw puts in their place; draw -1 is as observed."""
    units = products.select("fold", F.col("p").alias("u")).distinct()
    moved = permutation(units, "u", draws, seed, ["fold"]).select("draw", "fold", F.col("u").alias("p"), F.col("other").alias("q"))
    same = units.select(F.lit(-1).alias("draw"), "fold", F.col("u").alias("p"), F.col("u").alias("q"))
    return moved.unionByName(same).join(products, ["fold", "p", "q"]).groupBy("draw").agg(F.sum("x").alias("energy"))
