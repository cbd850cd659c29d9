"""Recovery, ranking, retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import average_rank, brier, log_loss, safe_ratio, sign_band
from .ranks import average_ranks, running


def recovery(df: DataFrame, keys: list[str], truth: Column, prediction: Column) -> DataFrame:
    """Energies, g, slope, scale, cosine and Pearson of a prediction, in one aggregate."""
    tt, pp, tp = F.sum(truth * truth), F.sum(prediction * prediction), F.sum(truth * prediction)
    return df.groupBy(*keys).agg(
        tt.alias("truth_energy"), (1 - safe_ratio(F.sum((truth - prediction) * (truth - prediction)), tt)).alias("g"), safe_ratio(tp, pp).alias("alpha"), safe_ratio(F.sqrt(pp), F.sqrt(tt)).alias("kappa"),
        safe_ratio(tp, F.sqrt(tt * pp)).alias("cosine"), F.corr(truth, prediction).alias("pearson"),
    )


def feature_r2(df: DataFrame, feature: str, truth: Column, prediction: Column) -> DataFrame:
    return df.groupBy(feature).agg((1 - safe_ratio(F.sum((truth - prediction) * (truth - prediction)), F.count(truth) * F.var_pop(truth))).alias("r2"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    ranked = df.withColumn("__rx", average_rank(F.col(x), *group)).withColumn("__ry", average_rank(F.col(y), *group))
    return ranked.groupBy(*group).agg(F.corr("__rx", "__ry").alias("rho"))


def kendall(df: DataFrame, unit: str, item: str, x: str, y: str) -> DataFrame:
    """Tau-b of each unit over all pairs of its items."""
    a, b = (df.select(unit, *(F.col(c).alias(f"{c}_{k}") for c in (item, x, y))) for k in "ab")
    p = a.join(b, unit).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))
    sx, sy = F.signum(F.col(f"{x}_a") - F.col(f"{x}_b")), F.signum(F.col(f"{y}_a") - F.col(f"{y}_b"))
    return p.groupBy(unit).agg(safe_ratio(F.sum(sx * sy), F.sqrt(F.sum(sx * sx) * F.sum(sy * sy))).alias("tau"))


def reversals(df: DataFrame, unit: str, item: str, truth: str, prediction: str, population: str, tolerance: float) -> DataFrame:
    """Confusion of predicted against true preference reversals, relative to the population's order of each pair."""
    a, b = (df.select(unit, *(F.col(c).alias(f"{c}_{k}") for c in (item, truth, prediction, population))) for k in "ab")
    p = a.join(b, unit).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))
    s = lambda c: sign_band(F.col(f"{c}_a") - F.col(f"{c}_b"), tolerance)
    p = p.select(unit, s(truth).alias("t"), s(prediction).alias("p"), s(population).alias("o")).filter("t <> 0 and o <> 0")
    real, told = F.col("t") != F.col("o"), (F.col("p") != F.col("o")) & (F.col("p") != 0)
    out = p.groupBy(unit).agg(F.count_if(real & told).alias("tp"), F.count_if(~real & told).alias("fp"), F.count_if(real & ~told).alias("fn"), F.count_if(~real & ~told).alias("tn"))
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    recall, spec = safe_ratio(c["tp"], c["tp"] + c["fn"]), safe_ratio(c["tn"], c["tn"] + c["fp"])
    mcc = safe_ratio(c["tp"] * c["tn"] - c["fp"] * c["fn"], F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])))
    return out.withColumn("balanced_accuracy", (recall + spec) / 2).withColumn("mcc", mcc)


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney from counts by distinct score: the sort is of scores, once each."""
    by = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    by = running(by.filter(F.col(score).isNotNull()), [F.col(score).asc()], {"below": F.col("neg")})
    return by.agg(safe_ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"))


def classification(df: DataFrame, keys: list[str], probs: Column, label: Column) -> DataFrame:
    """Accuracy, Brier score, log loss and balanced accuracy of probability arrays."""
    best = F.array_position(probs, F.array_max(probs)) - 1
    hit = (best == label).cast("double")
    each = df.groupBy(*keys, label.alias("__y")).agg(F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"), F.sum(brier(probs, label)).alias("b"), F.sum(log_loss(F.get(probs, label.cast("int")))).alias("l"))
    return each.groupBy(*keys).agg((F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("l") / F.sum("n")).alias("logloss"), F.avg("recall").alias("balanced_accuracy"))


def retrieval(sims: DataFrame, query: str, target: str, sim: str) -> DataFrame:
    """Rank of the true match (query = target) among all targets, and its cosine beside the median mismatch."""
    own = sims.filter(F.col(query) == F.col(target)).select(F.col(query).alias("__q"), F.col(sim).alias("own"))
    j = sims.join(own, F.col(query) == F.col("__q"))
    return j.groupBy(query).agg((F.count_if((F.col(sim) > F.col("own")) & (F.col(query) != F.col(target))) + 1).alias("rank"), F.first("own").alias("matched"), F.median(F.when(F.col(query) != F.col(target), F.col(sim))).alias("mismatched"))


def retrieval_summary(ranks: DataFrame, items: int) -> DataFrame:
    r = F.col("rank")
    return ranks.agg(F.avg(1 / r).alias("mrr"), F.avg((r <= 1).cast("double")).alias("top1"), F.avg((r <= 5).cast("double")).alias("top5"), F.avg(r.cast("double")).alias("mean_rank"), F.avg(1 - (r - 1) / F.lit(float(items - 1))).alias("percentile"))


def spectrum(values: DataFrame, value: str) -> DataFrame:
    """Participation ratio, entropy rank and components that reach half and nine tenths, from non-negative eigenvalues."""
    v = values.filter(F.col(value) > 0)
    w = Window.orderBy(F.col(value).desc())
    p = F.col(value) / F.sum(value).over(Window.partitionBy())
    v = v.withColumn("p", p).withColumn("i", F.row_number().over(w)).withColumn("cum", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reach = lambda t: F.min(F.when(F.col("cum") >= t - 1e-12, F.col("i")))
    return v.agg((1 / F.sum(F.col("p") * F.col("p"))).alias("participation"), F.exp(-F.sum(F.col("p") * F.log("p"))).alias("entropy_rank"), reach(0.5).alias("k50"), reach(0.9).alias("k90"))


def pareto(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Rows that no other beats in both (larger is better): a running maximum, not a self-join."""
    return running(df, [F.col(x).desc(), F.col(y).desc(), F.col(tie).asc()], highest={"__best": F.col(y)}).filter(F.col("__best").isNull() | (F.col(y) > F.col("__best"))).drop("__best")


def topk_overlap(df: DataFrame, unit: str, item: str, truth: str, prediction: str, k: int) -> DataFrame:
    """Share of the true top k that is in the predicted top k, and whether the sets are equal."""
    top = lambda c, name: df.withColumn("__r", F.row_number().over(Window.partitionBy(unit).orderBy(F.col(c).desc(), item))).filter(F.col("__r") <= k).select(unit, item, F.lit(1).alias(name))
    both = top(truth, "t").join(top(prediction, "p"), [unit, item], "full_outer")
    return both.groupBy(unit).agg((F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()) / k).alias("overlap"), F.bool_and(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("exact"))


def partial_spearman(df: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """Rank correlation of x and y with the ranks of a control taken out of both, from three correlations in one aggregate."""
    ranked = average_ranks(df.select(x, y, control), x, y, control)
    c = ranked.agg(F.corr(f"r_{x}", f"r_{y}").alias("xy"), F.corr(f"r_{x}", f"r_{control}").alias("xc"), F.corr(f"r_{y}", f"r_{control}").alias("yc"))
    return c.select(safe_ratio(F.col("xy") - F.col("xc") * F.col("yc"), F.sqrt((1 - F.col("xc") * F.col("xc")) * (1 - F.col("yc") * F.col("yc")))).alias("rho"))


def geometry_reliability(distances: DataFrame, k: int) -> DataFrame:
    """Of pairs a < b with distances da and db from two measurements: rank and linear correlation, mean overlap of k nearest neighbours, share of equal nearest ones."""
    ranked = distances.select("da", "db", average_rank(F.col("da")).alias("ra"), average_rank(F.col("db")).alias("rb"))
    rho = ranked.agg(F.corr("ra", "rb").alias("spearman"), F.corr("da", "db").alias("pearson"))
    both = distances.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "da", "db"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "da", "db"))))
    near = lambda c: F.row_number().over(Window.partitionBy("u").orderBy(c, "v"))
    n = both.withColumn("ka", near("da")).withColumn("kb", near("db")).groupBy("u").agg((F.count_if((F.col("ka") <= k) & (F.col("kb") <= k)) / k).alias("o"), F.max(((F.col("ka") == 1) & (F.col("kb") == 1)).cast("double")).alias("one"))
    return rho.join(F.broadcast(n.agg(F.avg("o").alias("knn_overlap"), F.avg("one").alias("nearest_agreement"))))


def support_table(weights: DataFrame, group: str) -> DataFrame:
    """Non-zero, positive and negative counts and norms of weights(group, feature, weight)."""
    w = F.col("weight")
    return weights.groupBy(group).agg(F.count_if(w != 0).alias("support"), F.count_if(w > 0).alias("up"), F.count_if(w < 0).alias("down"), F.sum(F.abs(w)).alias("l1"), F.sqrt(F.sum(w * w)).alias("l2"))


def dominated(df: DataFrame, key: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Keys that some other row matches in both within the tolerance and beats in one by more than it. For tables of summary rows."""
    a, b = df.select(F.col(key).alias("k"), F.col(x).alias("ax"), F.col(y).alias("ay")), df.select(F.col(x).alias("bx"), F.col(y).alias("by"))
    ge = (F.col("bx") >= F.col("ax") - tolerance) & (F.col("by") >= F.col("ay") - tolerance)
    gt = (F.col("bx") > F.col("ax") + tolerance) | (F.col("by") > F.col("ay") + tolerance)
    return a.join(b, ge & gt, "left_semi").select(F.col("k").alias(key))


def trend_audit(df: DataFrame, group: str, value: str, least_trend: float, least_share: float) -> DataFrame:
    """Rank correlation of ordered groups with their medians, share of variance between groups, and the verdict that both give. Groups are few."""
    each = df.groupBy(group).agg(F.median(value).alias("m"), F.count(value).alias("n"), F.avg(value).alias("a"))
    a, b = F.rank().over(Window.orderBy(group)), F.rank().over(Window.orderBy("m")) + (F.count(F.lit(1)).over(Window.partitionBy("m")) - 1) / 2
    trend = each.withColumn("__a", a).withColumn("__b", b).agg(F.corr("__a", "__b").alias("trend"))
    whole = df.agg(F.avg(value).alias("g"), (F.var_pop(value) * F.count(value)).alias("t"))
    eta = each.join(F.broadcast(whole)).agg((F.sum(F.col("n") * (F.col("a") - F.col("g")) * (F.col("a") - F.col("g"))) / F.first("t")).alias("eta2"))  # one row
    out = trend.join(F.broadcast(eta))
    return out.withColumn("verdict", F.when((F.abs("trend") >= least_trend) & (F.col("eta2") >= least_share), "graded").when(F.col("eta2") >= least_share, "different").otherwise("flat"))
