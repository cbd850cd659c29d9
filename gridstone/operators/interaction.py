"""Interaction algebra over response(replicate, context, intervention, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio

CELL = ("replicate", "feature")


def two_way(df: DataFrame, value: str = "value") -> DataFrame:
    """value less row and column means plus the grand mean, in each replicate and feature; nulls stay null and count for no mean.

    Means are small grouped tables that join back, one grouping of the fact each; no sort of it.
    """
    mean = lambda name, *keys: df.groupBy(*CELL, *keys).agg(F.avg(value).alias(name))
    out = df.join(mean("__row", "context"), [*CELL, "context"]).join(mean("__col", "intervention"), [*CELL, "intervention"]).join(mean("__all"), [*CELL])
    return out.withColumn("gamma", F.col(value) - F.col("__row") - F.col("__col") + F.col("__all")).drop("__row", "__col", "__all")


def context_effect_removed(df: DataFrame) -> DataFrame:
    mean = df.groupBy(*CELL, "context").agg(F.avg("value").alias("__m"))
    return df.join(mean, [*CELL, "context"]).withColumn("residual", F.col("value") - F.col("__m")).drop("__m")


def three_way(df: DataFrame, a: str, b: str, c: str, value: str, by: list[str]) -> DataFrame:
    """Balanced three-way components: a x b, a x c, b x c and a x b x c effects of each cell."""
    m = lambda *keys: F.avg(value).over(Window.partitionBy(*by, *keys))
    df = df.withColumns({"__g": m(), "__a": m(a), "__b": m(b), "__c": m(c), "__ab": m(a, b), "__ac": m(a, c), "__bc": m(b, c)})
    col = F.col
    pair = lambda xy, x, y: col(xy) - col(x) - col(y) + col("__g")
    df = df.withColumns({"ab": pair("__ab", "__a", "__b"), "ac": pair("__ac", "__a", "__c"), "bc": pair("__bc", "__b", "__c")})
    abc = col(value) - col("__ab") - col("__ac") - col("__bc") + col("__a") + col("__b") + col("__c") - col("__g")
    return df.withColumn("abc", abc).drop("__g", "__a", "__b", "__c", "__ab", "__ac", "__bc")


def leave_one_out_mean(df: DataFrame, *group: str) -> DataFrame:
    """The mean of the others of the group, as (sum - x) / (n - 1); null for a group of one."""
    w = Window.partitionBy(*group)
    return df.withColumn("loo", safe_ratio(F.sum("value").over(w) - F.col("value"), F.count("value").over(w) - 1))


def strict_leave_one_out_mean(df: DataFrame) -> DataFrame:
    """The mean over other contexts, by exclusion before any arithmetic: nothing of the held-out value enters, not even rounding.

    The sum of the contexts before plus that of those after, each a running sum in the order of the contexts, so that runs agree to the last bit; linear in contexts.
    """
    cell = Window.partitionBy("replicate", "intervention", "feature")
    up, down = (cell.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("context").asc(), F.col("context").desc()))
    total = lambda f: F.coalesce(f("value").over(up), F.lit(0)) + F.coalesce(f("value").over(down), F.lit(0))
    return df.withColumn("loo", safe_ratio(total(F.sum), total(F.count).cast("double")))


def all_but_one_deltas(df: DataFrame, *group: str) -> DataFrame:
    """x less the mean of the others: n / (n - 1) * (x - mean)."""
    w = Window.partitionBy(*group)
    n = F.count("value").over(w)
    return df.withColumn("delta", safe_ratio(n * (F.col("value") - F.avg("value").over(w)), n - 1))


def packed(df: DataFrame, value: str = "value") -> DataFrame:
    """replicate, context, intervention, xs: the features of a cell as an array in feature order."""
    return df.groupBy("replicate", "context", "intervention").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", value))), lambda s: s[value]).alias("xs"))


def gram(df: DataFrame, value: str = "value") -> DataFrame:
    """intervention, ctx_a, ctx_b, rep_a, rep_b, dot over features. Features are packed first, so that the self-join isn't squared by them."""
    p = packed(df, value)
    a = p.select("intervention", F.col("context").alias("ctx_a"), F.col("replicate").alias("rep_a"), F.col("xs").alias("x"))
    b = p.select("intervention", F.col("context").alias("ctx_b"), F.col("replicate").alias("rep_b"), F.col("xs").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    return a.join(b, "intervention").select("intervention", "ctx_a", "ctx_b", "rep_a", "rep_b", dot.alias("dot"))


def context_gram(g: DataFrame) -> DataFrame:
    """ctx_a, ctx_b -> dot summed over interventions within replicates."""
    return g.filter("rep_a = rep_b").groupBy("ctx_a", "ctx_b").agg(F.sum("dot").alias("dot"))


def centered(g: DataFrame) -> DataFrame:
    """HKH of a context Gram in long form."""
    rows = g.groupBy("ctx_a").agg(F.avg("dot").alias("ra"))
    cols = g.groupBy("ctx_b").agg(F.avg("dot").alias("rb"))
    grand = g.agg(F.avg("dot").alias("rr"))
    return g.join(rows, "ctx_a").join(cols, "ctx_b").join(F.broadcast(grand)).select("ctx_a", "ctx_b", (F.col("dot") - F.col("ra") - F.col("rb") + F.col("rr")).alias("dot"))


def gram_distances(g: DataFrame, features: int) -> DataFrame:
    """ctx_a < ctx_b: root mean squared distance and cosine from a Gram."""
    norm = g.filter("ctx_a = ctx_b").select(F.col("ctx_a").alias("c"), F.col("dot").alias("sq"))
    df = g.filter("ctx_a < ctx_b").join(norm.withColumnsRenamed({"c": "ctx_a", "sq": "aa"}), "ctx_a").join(norm.withColumnsRenamed({"c": "ctx_b", "sq": "bb"}), "ctx_b")
    d = F.sqrt(F.greatest(F.col("aa") + F.col("bb") - 2 * F.col("dot"), F.lit(0.0)) / features)
    return df.select("ctx_a", "ctx_b", d.alias("distance"), safe_ratio(F.col("dot"), F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"))


def cross_replicate(df: DataFrame, *columns: str) -> DataFrame:
    """Both replicates of each cell side by side: column0, column1."""
    keys = ["context", "intervention", "feature"]
    side = lambda r: df.filter(F.col("replicate") == r).select(*keys, *(F.col(c).alias(f"{c}{r}") for c in columns))
    return side(0).join(side(1), keys)


def energies(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """context, intervention -> s, e: signed cross-replicate energy of the truth and of the error."""
    x = cross_replicate(df.withColumn("__err", F.col(truth) - F.col(prediction)), truth, "__err")
    return x.groupBy("context", "intervention").agg(F.sum(F.col(f"{truth}0") * F.col(f"{truth}1")).alias("s"), F.sum(F.col("__err0") * F.col("__err1")).alias("e"))


def fgu(s: Column, e: Column, full: Column) -> dict[str, Column]:
    """F = s / full, g = 1 - e / s, U = (s - e) / full; null where a denominator isn't positive."""
    return {"f": safe_ratio(s, full), "g": 1 - safe_ratio(e, s), "u": safe_ratio(s - e, full)}


def residual_energy(g: DataFrame, weights: DataFrame) -> DataFrame:
    """w' K w by intervention for coefficients weights(context, w), across replicates, by a bilinear join of a Gram."""
    a, b = (weights.select(F.col("context").alias(f"ctx_{k}"), F.col("w").alias(f"w_{k}")) for k in "ab")
    return g.filter("rep_a = 0 and rep_b = 1").join(a, "ctx_a").join(b, "ctx_b").groupBy("intervention").agg(F.sum(F.col("w_a") * F.col("dot") * F.col("w_b")).alias("energy"))


def complete(df: DataFrame) -> DataFrame:
    """Contexts whose every intervention has every replicate and feature."""
    want = df.agg(F.count_distinct("intervention", "replicate", "feature").alias("want"))
    have = df.filter("value is not null").groupBy("context").agg(F.count_distinct("intervention", "replicate", "feature").alias("have"))
    return have.join(F.broadcast(want), F.col("have") == F.col("want")).select("context")


def grid(df: DataFrame) -> DataFrame:
    """The whole design with observed flags: the product of the axes, each of which is small, left-joined to the cells."""
    axes = [df.select(c).distinct() for c in ("context", "intervention", "replicate")]
    full = axes[0].crossJoin(axes[1]).crossJoin(axes[2])
    cell = df.select("context", "intervention", "replicate").distinct().withColumn("observed", F.lit(True))
    return full.join(cell, ["context", "intervention", "replicate"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def project(df: DataFrame, loadings: DataFrame) -> DataFrame:
    """Scores of cells on axes: sum of value * weight over loadings(axis, feature, weight)."""
    return df.join(loadings, "feature").groupBy("replicate", "context", "intervention", "axis").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
