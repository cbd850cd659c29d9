"""Closed-form predictors. Relational where sums do; small dense solves by group in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def affine_weights(gram: np.ndarray, cross: np.ndarray, ridge: float) -> np.ndarray:
    """Weights that sum to one and minimise w'Gw - 2 w'c + ridge * trace(G)/n * |w|^2."""
    n = len(cross)
    a = gram + ridge * max(np.trace(gram) / n, 1e-12) * np.eye(n)
    kkt = np.block([[a, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    return np.linalg.lstsq(kkt, np.append(cross, 1.0), rcond=None)[0][:n]


def fit_affine(gram: DataFrame, ridge: float, rank: int | None = None) -> DataFrame:
    """context, source, weight: each context from all others, on a context Gram(ctx_a, ctx_b, dot); with a rank, deviations from equal weights stay in the Gram's leading axes. A group is one context's Gram."""
    held = gram.select(F.col("ctx_a").alias("context")).distinct()
    pairs = held.join(gram, F.col("ctx_a") != F.col("context"))

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.ctx_a.unique())
        at = {c: i for i, c in enumerate(names)}
        g, c = np.zeros((len(names), len(names))), np.zeros(len(names))
        for a, b, d in zip(pdf["ctx_a"], pdf["ctx_b"], pdf["dot"]):
            if b == key[0]:
                c[at[a]] = d
            else:
                g[at[a], at[b]] = d
        w = affine_weights(g, c, ridge)
        if rank is not None:
            h = np.eye(len(names)) - 1 / len(names)
            axes = np.linalg.eigh(h @ g @ h)[1][:, -rank:]
            w = 1 / len(names) + axes @ (axes.T @ (w - 1 / len(names)))
            w = w + (1 - w.sum()) / len(names)
        return pd.DataFrame({"context": key[0], "source": names, "weight": w})

    return pairs.groupBy("context").applyInPandas(solve, "context string, source string, weight double")


def weighted_prediction(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Predictions as weighted sums over source contexts."""
    source = df.select("replicate", "intervention", "feature", F.col("context").alias("source"), F.col("value").alias("x"))
    p = weights.join(source, "source").groupBy("replicate", "context", "intervention", "feature").agg(F.sum(F.col("weight") * F.col("x")).alias("prediction"))
    return df.join(p, ["replicate", "context", "intervention", "feature"])


def ols(df: DataFrame, keys: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """Slope and intercept by group; the mean where a group has fewer rows than least."""
    few = F.count(F.lit(1)) < least
    return df.groupBy(*keys).agg(F.when(few, F.lit(0.0)).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(few, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"))


def conformal_cut(cal: DataFrame, keys: list[str], score: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest calibration score of each key; infinite where there are too few."""
    w = Window.partitionBy(*keys)
    need = F.ceil((F.count(F.lit(1)).over(w) + 1) * F.lit(1 - alpha))
    ranked = cal.withColumn("__r", F.row_number().over(w.orderBy(score))).withColumn("__k", need)
    return ranked.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__r") == F.col("__k"), F.col(score))), F.lit(float("inf"))).alias("cut"))


def saturating_fit(points: DataFrame, curve: str, x: str, y: str, rates: list[float]) -> DataFrame:
    """y = a + b exp(-rate x): least squares in a and b for each rate of a grid, the best rate by squared error."""
    p = points.withColumn("rate", F.explode(F.array(*map(F.lit, rates)))).withColumn("z", F.exp(-F.col("rate") * F.col(x)))
    fit = p.groupBy(curve, "rate").agg(F.regr_slope(y, "z").alias("b"), F.regr_intercept(y, "z").alias("a"), F.regr_syy(y, "z").alias("syy"), F.regr_sxy(y, "z").alias("sxy"))
    fit = fit.withColumn("sse", F.col("syy") - F.col("b") * F.col("sxy"))
    return fit.groupBy(curve).agg(F.min_by(F.struct("rate", "a", "b", "sse"), F.struct("sse", "rate")).alias("f")).select(curve, "f.rate", "f.a", "f.b", "f.sse")


def kernel_ridge(vectors: DataFrame, folds: DataFrame, alpha: float, dims: int) -> DataFrame:
    """Held-out predictions of y(id, x array, y) by fold: train-only centring and PCA, RBF kernel with the median train distance.

    A task holds one fold's rows; the rows are an axis of the design.
    """
    rows = vectors.join(folds, "id")
    every = folds.select(F.col("fold").alias("held")).distinct()
    both = rows.join(F.broadcast(every))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        test = (pdf.fold == key[0]).to_numpy()
        x, y = np.stack(pdf.x.to_numpy()).astype(float), pdf.y.to_numpy(float)
        centre = x[~test].mean(0)
        _, _, axes = np.linalg.svd(x[~test] - centre, full_matrices=False)
        z = (x - centre) @ axes[:dims].T
        d = ((z[:, None, :] - z[~test][None, :, :]) ** 2).sum(-1)
        train = d[~test]
        width = np.median(train[train > 0]) if (train > 0).any() else 1.0
        k = np.exp(-d / width)
        mean = y[~test].mean()
        w = np.linalg.solve(k[~test] + alpha * np.eye((~test).sum()), y[~test] - mean)
        return pd.DataFrame({"id": pdf.id[test], "fold": key[0], "y": y[test], "prediction": mean + k[test] @ w})

    return both.groupBy("held").applyInPandas(run, "id long, fold int, y double, prediction double")




def power_fit(points: DataFrame, curve: str, x: str, y: str, rates: list[float]) -> DataFrame:
    """y = a + b x^-rate and the constant, by AICc: least squares for each rate of a grid, three parameters against one."""
    p = points.withColumn("rate", F.explode(F.array(*map(F.lit, rates)))).withColumn("z", F.pow(F.col(x), -F.col("rate")))
    fit = p.groupBy(curve, "rate").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, "z").alias("b"), F.regr_intercept(y, "z").alias("a"), F.regr_syy(y, "z").alias("syy"), F.regr_sxy(y, "z").alias("sxy"))
    fit = fit.withColumn("sse", F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(1e-12)))
    best = fit.groupBy(curve).agg(F.min_by(F.struct("rate", "a", "b", "sse", "syy", "n"), F.struct("sse", "rate")).alias("f")).select(curve, "f.*")
    n = F.col("n").cast("double")
    aicc = lambda sse, k: n * F.log(sse / n) + 2 * k + F.lit(2.0 * k * (k + 1)) / (n - k - 1)
    best = best.withColumn("aicc_power", aicc(F.col("sse"), 4)).withColumn("aicc_constant", aicc(F.greatest(F.col("syy"), F.lit(1e-12)), 2))
    return best.select(curve, "rate", "a", "b", "aicc_power", "aicc_constant", F.when(F.col("aicc_power") < F.col("aicc_constant"), "power").otherwise("constant").alias("model"))


def contexts_for_target(fits: DataFrame, curve: str, target: float) -> DataFrame:
    """The x at which a + b x^-rate reaches the target; null where it never does."""
    ratio = (F.lit(target) - F.col("a")) / F.col("b")
    return fits.select(curve, F.when(ratio > 0, F.pow(ratio, -1 / F.col("rate"))).alias("needed"))


def select_penalty(fold_grams: DataFrame, ridges: list[float]) -> DataFrame:
    """ridge, error and whether it is picked: affine weights of every penalty, fitted without an inner fold and scored on it, summed over folds and contexts; ties to the larger penalty. fold_grams: see sealed.by_fold."""
    from .sealed import nested_penalty

    out = nested_penalty(fold_grams, ridges).groupBy("ridge").agg(F.sum("error").alias("error"))
    best = F.max_by("ridge", F.struct((-F.round("error", 9)).alias("e"), "ridge")).over(Window.partitionBy())  # a row a penalty
    return out.withColumn("picked", F.col("ridge") == best)


def landmark_ridge(vectors: DataFrame, folds: DataFrame, alpha: float, landmarks: int) -> DataFrame:
    """id, fold, y, prediction: kernel ridge over any number of rows, by the RBF kernel to landmarks.

    vectors(id, x array, y), folds(id, fold). Each fold's landmarks are the training rows with the smallest hash; the width
    is their median distance. A row's kernel values to them are its features; normal equations are summed by partition, as
    many numbers as (landmarks + 1) ** 2 a fold, and solved on the driver. No row is left out, no task holds a fold.
    """
    rows = vectors.join(folds, "id").select("id", "fold", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())
    kind = {}
    for k in numbers:
        few = rows.filter(F.col("fold") != k).orderBy(F.xxhash64("id"), "id").limit(landmarks).select("x").collect()
        z = np.array([r.x for r in few])
        d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(-1)
        kind[k] = (z, float(np.median(d[d > 0])) if (d > 0).any() else 1.0)
    held = vectors.sparkSession.sparkContext.broadcast(kind)

    def features(x: np.ndarray, k: int) -> np.ndarray:
        z, width = held.value[k]
        d = (x**2).sum(1)[:, None] + (z**2).sum(1) - 2 * x @ z.T
        return np.concatenate([np.exp(-np.maximum(d, 0) / width), np.ones((len(x), 1))], 1)

    def sums(batches):
        total = {}
        for pdf in batches:
            x, y, fold = np.stack(pdf.x.to_numpy()), pdf.y.to_numpy(), pdf.fold.to_numpy()
            for k in held.value:
                t = fold != k
                f = np.concatenate([features(x[t], k), y[t][:, None]], 1)
                total[k] = total.get(k, 0) + f.T @ f
        for k, m in total.items():
            yield pd.DataFrame({"fold": k, "place": np.arange(m.size), "v": m.ravel()})

    summed = rows.mapInPandas(sums, "fold int, place int, v double").groupBy("fold", "place").agg(F.sum("v").alias("v")).toPandas()
    coefs = {}
    for k, own in summed.groupby("fold"):
        n = len(kind[k][0]) + 1
        m = own.sort_values("place").v.to_numpy().reshape(n + 1, n + 1)
        penalty = alpha * np.eye(n)
        penalty[-1, -1] = 0
        coefs[int(k)] = np.linalg.solve(m[:n, :n] + penalty, m[:n, n])
    solved = vectors.sparkSession.sparkContext.broadcast(coefs)

    def predict(batches):
        for pdf in batches:
            x, out = np.stack(pdf.x.to_numpy()), np.zeros(len(pdf))
            for k in solved.value:
                t = (pdf.fold == k).to_numpy()
                if t.any():
                    out[t] = features(x[t], k) @ solved.value[k]
            yield pd.DataFrame({"id": pdf.id, "fold": pdf.fold, "y": pdf.y, "prediction": out})

    return rows.mapInPandas(predict, "id long, fold int, y double, prediction double")


def prediction_sets(test: DataFrame, cuts: DataFrame, probs: str) -> DataFrame:
    """Each row's set of labels whose 1 - p is at most the cut of the label; an empty set becomes the full one."""
    by = cuts.agg(F.map_from_entries(F.collect_list(F.struct(F.col("label"), F.col("cut")))).alias("cuts"))
    df = test.join(F.broadcast(by))
    held = F.filter(F.transform(probs, lambda p, i: F.when(1 - p <= F.element_at("cuts", i) + 1e-12, i)), lambda x: x.isNotNull())
    df = df.withColumn("__set", held).withColumn("replaced", F.size("__set") == 0)
    return df.withColumn("labels", F.when(F.col("replaced"), F.sequence(F.lit(0), F.size(probs) - 1)).otherwise(F.col("__set"))).drop("__set", "cuts")


def set_quality(sets: DataFrame, label: str) -> DataFrame:
    return sets.agg(F.avg(F.size("labels").cast("double")).alias("size"), F.avg(F.array_contains("labels", F.col(label).cast("int")).cast("double")).alias("covered"), F.avg((F.size("labels") == 1).cast("double")).alias("singleton"))


def ridge_by_intervention(df: DataFrame, features: DataFrame, alpha: float) -> DataFrame:
    """context, intervention, prediction: for each intervention a ridge from context features, around the mean of the other contexts; the predicted context is left out.

    df(context, intervention, value), features(context, h array). A task holds one intervention's contexts.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("context")
        h, y = np.stack(pdf.h.to_numpy()).astype(float), pdf.value.to_numpy(float)
        out = []
        for i in range(len(y)):
            t = np.arange(len(y)) != i
            m, mh = y[t].mean(), h[t].mean(0)
            z = h[t] - mh
            w = np.linalg.solve(z.T @ z + alpha * np.eye(h.shape[1]), z.T @ (y[t] - m))
            out.append(m + float((h[i] - mh) @ w))
        return pd.DataFrame({"context": pdf.context, "intervention": key[0], "value": y, "prediction": out})

    return df.join(features, "context").groupBy("intervention").applyInPandas(run, "context string, intervention string, value double, prediction double")


def episode_weights(gram: DataFrame, episodes: DataFrame, ridge: float = 0.0, rcond: float = 1e-10) -> DataFrame:
    """episode, source, weight: affine weights of many episodes, each from its own sources, by singular values of its KKT system.

    gram(ctx_a, ctx_b, dot), episodes(episode, target, source). The pairs of sources that an episode needs are joined to the Gram,
    so that a task holds the Gram of one episode's sources alone; sources that depend on each other share the least weights.
    An episode with one source gives it all.
    """
    cross = episodes.join(gram, (F.col("source") == F.col("ctx_a")) & (F.col("target") == F.col("ctx_b"))).select("episode", F.col("source").alias("a"), F.lit(None).cast("string").alias("b"), "dot")
    other = episodes.select("episode", F.col("source").alias("other"))
    pairs = episodes.select("episode", "source").join(other, "episode")  # sources of an episode: contexts of the design
    inner = pairs.join(gram, (F.col("source") == F.col("ctx_a")) & (F.col("other") == F.col("ctx_b"))).select("episode", F.col("source").alias("a"), F.col("other").alias("b"), "dot")

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf[pdf.b.isna()].sort_values("a")
        names, n = list(c.a), len(c)
        g = pdf[pdf.b.notna()].pivot(index="a", columns="b", values="dot").reindex(index=names, columns=names).to_numpy(float)
        g = g + ridge * max(np.trace(g) / n, 1e-12) * np.eye(n)
        kkt = np.block([[g, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        w = np.linalg.pinv(kkt, rcond=rcond) @ np.append(c["dot"].to_numpy(float), 1.0)
        return pd.DataFrame({"episode": key[0], "source": names, "weight": w[:n]})

    kind = episodes.schema["episode"].dataType.simpleString()
    return cross.unionByName(inner).groupBy("episode").applyInPandas(solve, f"episode {kind}, source string, weight double")


def episode_errors(gram: DataFrame, episodes: DataFrame, weights: DataFrame) -> DataFrame:
    """episode, target, m (its number of sources), energy, error: the target's energy and its squared error under the episode's weights, from a Gram alone."""
    sized = episodes.groupBy("episode", "target").agg(F.count(F.lit(1)).alias("m"))
    w = weights.select("episode", F.col("source").alias("c"), F.col("weight").alias("w")).unionByName(sized.select("episode", F.col("target").alias("c"), F.lit(-1.0).alias("w")))
    a, b = (w.select("episode", F.col("c").alias(f"ctx_{k}"), F.col("w").alias(f"w{k}")) for k in "ab")
    e = a.join(b, "episode").join(gram, ["ctx_a", "ctx_b"]).groupBy("episode").agg(F.sum(F.col("wa") * F.col("dot") * F.col("wb")).alias("error"))
    own = gram.filter("ctx_a = ctx_b").select(F.col("ctx_a").alias("target"), F.col("dot").alias("energy"))
    return sized.join(own, "target").join(e, "episode").select("episode", "target", "m", "energy", "error")
