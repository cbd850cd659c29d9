"""Boosted regression trees by histograms that Spark adds up: no row leaves the executors.

Features are binned by exact quantile edges. A level of a tree is one aggregate: gradients
and rows summed by (node, feature, bin), with partial sums before the shuffle; windows over
bins, of which a node and feature have BINS at most, give each cut's gain; the best cut of a
node comes back to the driver, 2 ** depth rows a level. A row's node and prediction are
column expressions of the trees so far, folded into a stored column every FOLD trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import stored
from .ranks import quantiles

BINS, FOLD = 32, 10


@dataclass
class Tree:
    """cuts: node -> (feature, bin), rows of at most the bin go left (node 2n, else 2n + 1); leaves: node -> value."""

    cuts: dict[int, tuple[str, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self, bins: str = "bins", at: int = 1) -> Column:
        """The node in which a row ends, from its map of bins."""
        if at not in self.cuts:
            return F.lit(at)
        feature, cut = self.cuts[at]
        return F.when(F.col(f"{bins}.{feature}") <= cut, self.node(bins, 2 * at)).otherwise(self.node(bins, 2 * at + 1))

    def value(self, bins: str = "bins", at: int = 1) -> Column:
        if at not in self.cuts:
            return F.lit(float(self.leaves.get(at, 0.0)))
        feature, cut = self.cuts[at]
        return F.when(F.col(f"{bins}.{feature}") <= cut, self.value(bins, 2 * at)).otherwise(self.value(bins, 2 * at + 1))


def edges(df: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """feature -> rising edges at its exact quantiles, bins - 1 at most."""
    long = df.select(*(F.col(f).cast("double").alias(f) for f in features)).unpivot([], features, "feature", "value")
    q = quantiles(long, ["feature"], "value", [k / bins for k in range(1, bins)])
    out: dict[str, list[float]] = {f: [] for f in features}
    for r in q.select("feature", "q").distinct().orderBy("feature", "q").collect():
        out[r.feature].append(float(r.q))
    return out


def binned(df: DataFrame, limits: dict[str, list[float]]) -> DataFrame:
    """df with bins, a struct of each feature's bin: how many edges its value exceeds; null counts as below all."""
    at = lambda f: F.size(F.filter(F.array(*map(F.lit, limits[f])), lambda e: e < F.col(f))) if limits[f] else F.lit(0)
    return df.withColumn("bins", F.struct(*(F.coalesce(F.when(F.col(f).isNotNull(), at(f)), F.lit(0)).cast("int").alias(f) for f in limits)))


def best_cuts(rows: DataFrame, features: list[str], l2: float, least: int) -> list:
    """node, feature, bin, gain, and the sums on both sides, of the best cut of each node with a gain; rows(node, bins, g)."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"bins.{f}").alias("bin")) for f in features)))
    cells = rows.select("node", "g", each.alias("c")).groupBy("node", "c.feature", "c.bin").agg(F.sum("g").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("node", "feature")  # a row a bin
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("node", "feature", "bin", F.sum("s").over(upto).alias("sl"), F.sum("n").over(upto).alias("nl"), F.sum("s").over(w).alias("sa"), F.sum("n").over(w).alias("na"))
    part = lambda s, n: s * s / (n + l2)
    sl, nl, sa, na = (F.col(c) for c in ("sl", "nl", "sa", "na"))
    cells = cells.filter((nl >= least) & (na - nl >= least)).withColumn("gain", part(sl, nl) + part(sa - sl, na - nl) - part(sa, na))
    best = cells.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gain"), F.struct(F.round("gain", 9), F.lit(None).cast("int"), -F.col("bin"), "feature")).alias("b"))
    return [r for r in best.select("node", "b.*").collect() if r.gain > 1e-12]


def fit(df: DataFrame, features: list[str], target: str, trees: int, depth: int = 3, rate: float = 0.1, l2: float = 1.0, least: int = 10, bins: int = BINS) -> tuple[float, list[Tree], dict[str, list[float]]]:
    """The base value (the mean), trees and edges of least-squares boosting on the rows of df. Equal gains go to the lower bin, then to the later name."""
    limits = edges(df, features, bins)
    used = df.filter(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias("y"))
    base = used.agg(F.avg("y")).first()[0] or 0.0
    rows = stored(binned(used, limits).select("bins", F.col("y"), F.lit(float(base)).alias("f")), "boost")
    out: list[Tree] = []
    fresh: list[Tree] = []
    for _ in range(trees):
        now = sum((t.value() for t in fresh), F.col("f"))
        grad = rows.select("bins", (F.col("y") - now).alias("g"))
        tree = Tree()
        for level in range(depth):
            at = grad.select("bins", "g", tree.node().alias("node")).filter(F.col("node") >= 1 << level)
            found = best_cuts(at, features, l2, least)
            if not found:
                break
            tree.cuts |= {r.node: (r.feature, r.bin) for r in found}
        sums = grad.groupBy(tree.node().alias("node")).agg((F.sum("g") / (F.count(F.lit(1)) + l2)).alias("v"))
        tree.leaves = {r.node: rate * r.v for r in sums.collect()}  # 2 ** depth rows
        out.append(tree)
        fresh.append(tree)
        if len(fresh) == FOLD:
            rows, fresh = stored(rows.withColumn("f", sum((t.value() for t in fresh), F.col("f"))), "boost"), []
    return float(base), out, limits


def predict(df: DataFrame, model: tuple[float, list[Tree], dict[str, list[float]]], name: str = "prediction") -> DataFrame:
    base, trees, limits = model
    return binned(df, limits).withColumn(name, sum((t.value() for t in trees), F.lit(base))).drop("bins")
