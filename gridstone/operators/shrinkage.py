"""Shrunk covariances from sums, proximities of pairs, and utilities of transfer.

df(group, row, name, value) is long; names are an axis of the design, rows are as many as there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio
from ..sources.facts import stored


def correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null where either side is constant."""
    flat = (F.var_pop(a) <= 1e-20) | (F.var_pop(b) <= 1e-20)
    return F.when(~flat, safe_ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def packed(df: DataFrame) -> DataFrame:
    """group, row, q, xs: a row's centred values by name, and the sum of their squares, written once for all that follows.

    Means are by group and name, axes of the design, and are broadcast, so that df is dealt once, by row, after what a task has of
    a row is added up in a column a name: sums of fixed width, which need no sorting. Values that a row has several of under one
    name are added up, as they meet all others of the row alike; their squares are kept apart.
    """
    mean = stored(df.groupBy("group", "name").agg(F.avg("value").alias("__m")), "means")
    names = sorted(r.name for r in mean.select("name").distinct().filter("name is not null").collect())
    kind = mean.schema["name"].dataType
    v = F.col("value") - F.col("__m")
    own = {n: F.col("name") == F.lit(n) for n in names}
    sums = [c for k, n in enumerate(names) for c in (F.sum(F.when(own[n], v)).alias(f"__s{k}"), F.max(F.when(own[n], F.lit(True))).alias(f"__h{k}"))]
    wide = df.join(F.broadcast(mean), ["group", "name"]).groupBy("group", "row").agg(F.sum(v * v).alias("q"), *sums)
    xs = F.filter(F.array(*(F.struct(F.lit(n).cast(kind).alias("name"), F.col(f"__s{k}").alias("value"), F.col(f"__h{k}").alias("held")) for k, n in enumerate(names))), lambda x: x["held"].isNotNull())
    if not names:
        xs = F.array().cast(f"array<struct<name:{kind.simpleString()},value:double,held:boolean>>")
    return stored(wide, "packed-rows").select("group", "row", "q", xs.alias("xs"))


def covariance(df: DataFrame) -> DataFrame:
    """group, a, b, cov: population covariances of names over rows. A row's names are packed before they are paired, so that rows meet no join."""
    return _covariance(packed(df))


def _covariance(rows: DataFrame) -> DataFrame:
    one = rows.select("group", "xs", F.explode("xs").alias("p")).select("group", F.col("p.name").alias("a"), F.col("p.value").alias("va"), F.explode("xs").alias("q"))
    sums = one.groupBy("group", "a", F.col("q.name").alias("b")).agg(F.sum(F.col("va") * F.col("q.value")).alias("s"))
    n = rows.groupBy("group").agg(F.count("row").alias("n"))
    return sums.join(n, "group").select("group", "a", "b", (F.col("s") / F.col("n")).alias("cov"))


def intensity(df: DataFrame, cov: DataFrame) -> DataFrame:
    """group, n, mu, shrinkage: the Ledoit-Wolf weight of mu times the identity, from second- and fourth-order sums.

    With S the covariance of p names, d2 = |S - mu I|^2 and b2 = (sum of |x|^4 / n - |S|^2) / n, it is min(b2, d2) / d2; 0 where S is mu I.
    """
    return _intensity(packed(df), cov)


def _intensity(rows: DataFrame, cov: DataFrame) -> DataFrame:
    fourth = rows.groupBy("group").agg((F.sum(F.col("q") * F.col("q"))).alias("fourth"), F.count(F.lit(1)).alias("n"))
    same = F.col("a") == F.col("b")
    s = cov.groupBy("group").agg(F.sum(F.col("cov") * F.col("cov")).alias("ss"), F.sum(F.when(same, F.col("cov"))).alias("trace"), F.count_if(same).alias("p"))
    both = s.join(fourth, "group").withColumn("mu", F.col("trace") / F.col("p"))
    d2 = F.col("ss") - F.col("p") * F.col("mu") * F.col("mu")
    b2 = F.least((F.col("fourth") / F.col("n") - F.col("ss")) / F.col("n"), d2)
    return both.select("group", "n", "mu", F.greatest(F.coalesce(safe_ratio(b2, d2), F.lit(0.0)), F.lit(0.0)).alias("shrinkage"))


def shrunk(df: DataFrame) -> DataFrame:
    """group, a, b, cov, shrinkage: (1 - shrinkage) S + shrinkage mu I."""
    rows = packed(df)
    s = stored(_covariance(rows), "covariances")
    w, same = F.col("shrinkage"), F.col("a") == F.col("b")
    both = s.join(_intensity(rows, s), "group")
    return both.select("group", "a", "b", ((1 - w) * F.col("cov") + F.when(same, w * F.col("mu")).otherwise(0.0)).alias("cov"), w.alias("shrinkage"))


def precision(cov: DataFrame) -> DataFrame:
    """group, a, b, precision: the inverse of each group's covariance, names by names in a task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
        inv = np.linalg.pinv(m.to_numpy(float), hermitian=True)
        return pd.DataFrame([(key[0], a, b, float(inv[i, j])) for i, a in enumerate(m.index) for j, b in enumerate(m.columns)], columns=["group", "a", "b", "precision"])

    kinds = {c: cov.schema[c].dataType.simpleString() for c in ("group", "a")}
    return cov.select("group", "a", "b", "cov").groupBy("group").applyInPandas(run, f"group {kinds['group']}, a {kinds['a']}, b {kinds['a']}, precision double")


def proximities(points: DataFrame, inverse: DataFrame) -> DataFrame:
    """group, source, target, cosine, pearson, euclidean, mahalanobis of pairs of points(group, point, name, value), the distances as minus themselves.

    Points are contexts, an axis of the design. All but the last follow from sums over names; the last needs group's precision(a, b).
    """
    side = lambda k: points.select("group", "name", F.col("point").alias(k), F.col("value").alias(f"v{k}"))
    both = side("s").join(side("t"), ["group", "name"]).filter("s <> t")
    x, y = F.col("vs"), F.col("vt")
    each = both.groupBy("group", "s", "t").agg(safe_ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"), correlation("vs", "vt").alias("pearson"), (-F.sqrt(F.sum((x - y) * (x - y)))).alias("euclidean"))
    d = both.select("group", "s", "t", "name", (x - y).alias("d"))
    form = d.withColumnsRenamed({"name": "a", "d": "da"}).join(inverse, ["group", "a"]).join(d.withColumnsRenamed({"name": "b", "d": "db"}), ["group", "s", "t", "b"])
    far = form.groupBy("group", "s", "t").agg((-F.sqrt(F.greatest(F.sum(F.col("da") * F.col("precision") * F.col("db")), F.lit(0.0)))).alias("mahalanobis"))
    return each.join(far, ["group", "s", "t"]).select("group", F.col("s").alias("source"), F.col("t").alias("target"), "cosine", "pearson", "euclidean", "mahalanobis")


def transfer_utility(scores: DataFrame, base: DataFrame) -> DataFrame:
    """program, source, target, mse, base_mse, mse_utility, pearson, base_pearson, pearson_utility over interventions.

    scores(context, program, intervention, score): a source's scores stand for a target's; base(program, target, intervention, score)
    is what they have to beat. Utilities: base error less error, correlation less base correlation. Pairs come from a join on
    (program, intervention), whose groups are contexts.
    """
    s = scores.select("program", "intervention", F.col("context").alias("source"), F.col("score").alias("x"))
    t = scores.select("program", "intervention", F.col("context").alias("target"), F.col("score").alias("y"))
    b = base.select("program", "target", "intervention", F.col("score").alias("z"))
    both = t.join(b, ["program", "target", "intervention"]).join(s, ["program", "intervention"]).filter("source <> target")
    sq = lambda c: F.avg((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    rho = lambda c: F.coalesce(correlation("y", c), F.lit(0.0))  # noqa: E731  a constant column counts as no correlation at all
    u = both.groupBy("program", "source", "target").agg(sq("x").alias("mse"), sq("z").alias("base_mse"), rho("x").alias("pearson"), rho("z").alias("base_pearson"))
    return u.withColumn("mse_utility", F.col("base_mse") - F.col("mse")).withColumn("pearson_utility", F.col("pearson") - F.col("base_pearson"))
