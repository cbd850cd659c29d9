"""Sufficient statistics of predictions, computed without sight of what is held out.

Facts are response(replicate, context, intervention, feature, value). A mask names hidden
cells; `sealed` takes them out before any arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio

CELL = ["replicate", "context", "intervention", "feature"]


def sealed(df: DataFrame, hidden: DataFrame) -> DataFrame:
    """df without the rows whose keys hidden has (columns of hidden): what a fit may read."""
    return df.join(hidden.distinct(), hidden.columns, "left_anti")


def refuse(df: DataFrame, hidden: DataFrame) -> DataFrame:
    """df, or an error where it still holds a hidden key."""
    seen = df.join(hidden.distinct().withColumn("__h", F.lit(True)), hidden.columns, "left")
    return seen.filter(F.when(F.col("__h"), F.raise_error(F.lit("a hidden row was asked for")).cast("boolean")).otherwise(F.lit(True))).drop("__h")


def parallel_orthogonal(df: DataFrame, by: list[str], truth: str, prediction: str) -> DataFrame:
    """by -> tp, tt, pp sums, the prediction's energy along the truth and across it."""
    t, p = F.col(truth), F.col(prediction)
    s = df.groupBy(*by).agg(F.sum(t * p).alias("tp"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"))
    along = safe_ratio(F.col("tp") * F.col("tp"), F.col("tt"))
    return s.withColumn("parallel", along).withColumn("orthogonal", F.col("pp") - along)


def library_contrast(df: DataFrame, unit: list[str], library: str, half: str, feature: str, value: str) -> DataFrame:
    """unit -> sum over features of the two libraries' difference in one half times that in the other, over 4: a floor of error that noise doesn't raise."""
    m = df.groupBy(*unit, library, half, feature).agg(F.avg(value).alias("m"))
    lib = m.groupBy(*unit, half, feature).agg((F.max_by("m", library) - F.min_by("m", library)).alias("d"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    both = lib.groupBy(*unit, feature).agg(F.max_by("d", half).alias("a"), F.min_by("d", half).alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return both.groupBy(*unit).agg((F.sum(F.col("a") * F.col("b")) / 4).alias("signal"), F.count(F.lit(1)).alias("features"))


def same_stats(df: DataFrame, weights: DataFrame, excess: bool = False) -> DataFrame:
    """context, replicate -> norm, dot with the truth and sum of the weighted prediction; with excess both less the sources' plain mean."""
    source = df.select("replicate", "intervention", "feature", F.col("context").alias("source"), F.col("value").alias("x"))
    p = weights.join(source, "source").groupBy("replicate", "context", "intervention", "feature").agg(F.sum(F.col("weight") * F.col("x")).alias("p"), F.avg("x").alias("m"))
    both = df.join(p, CELL)
    less = F.col("m") if excess else F.lit(0.0)
    t, q = F.col("value") - less, F.col("p") - less
    return both.groupBy("context", "replicate").agg(F.sum(q * q).alias("norm"), F.sum(t * q).alias("dot"), F.sum(q).alias("total"))


def offset_stats(df: DataFrame, prediction: str, sentinels: Column, alpha: float) -> DataFrame:
    """context -> energy of the sentinels' mean error, its product with the other cells' error and what is left of that after alpha times the offset."""
    err = df.withColumn("__e", F.col("value") - F.col(prediction)).withColumn("__s", sentinels)
    off = err.filter("__s").groupBy("replicate", "context", "feature").agg(F.avg("__e").alias("o"))
    both = err.filter(~F.col("__s")).join(off, ["replicate", "context", "feature"])
    e, o = F.col("__e"), F.col("o")
    return both.groupBy("context").agg(F.sum(o * o).alias("offset"), F.sum(e * o).alias("cross"), F.sum((e - alpha * o) * (e - alpha * o)).alias("residual"))


def identity_null(df: DataFrame, prediction: str, pairs: DataFrame) -> DataFrame:
    """shift, context -> squared error where each intervention is predicted by what another one was predicted to be; pairs(shift, intervention, other)."""
    other = df.select("replicate", "context", "feature", F.col("intervention").alias("other"), F.col(prediction).alias("__p"))
    both = df.select(*CELL, "value").join(pairs, "intervention").join(other, ["replicate", "context", "feature", "other"])
    d = F.col("value") - F.col("__p")
    return both.groupBy("shift", "context").agg(F.sum(d * d).alias("residual"))


def masked_baseline(df: DataFrame, hidden: Column) -> DataFrame:
    """Cells that are hidden, with the mean of the same cell over contexts where it isn't: nothing hidden enters."""
    df = df.withColumn("__h", hidden)
    seen = df.filter(~F.col("__h")).groupBy("replicate", "intervention", "feature").agg(F.avg("value").alias("baseline"), F.count(F.lit(1)).alias("sources"))
    return df.filter("__h").join(seen, ["replicate", "intervention", "feature"], "left").drop("__h")


def additive_completion(df: DataFrame, hidden: Column) -> DataFrame:
    """df with filled: the value where it is seen, else row plus column less grand mean of the seen cells of its replicate and feature."""
    df = df.withColumn("__h", hidden)
    seen = df.filter(~F.col("__h"))
    mean = lambda name, *keys: seen.groupBy("replicate", "feature", *keys).agg(F.avg("value").alias(name))
    out = df.join(mean("__r", "context"), ["replicate", "feature", "context"], "left").join(mean("__c", "intervention"), ["replicate", "feature", "intervention"], "left").join(mean("__g"), ["replicate", "feature"], "left")
    fill = F.coalesce("__r", "__g") + F.coalesce("__c", "__g") - F.col("__g")
    return out.withColumn("filled", F.when(F.col("__h"), fill).otherwise(F.col("value"))).withColumn("hidden", F.col("__h")).drop("__h", "__r", "__c", "__g")


def low_rank_stats(scores: DataFrame, unit: list[str], basis_gram: DataFrame) -> DataFrame:
    """unit -> squared norm of what scores(unit, axis, score) predict, from the axes' Gram(axis_a, axis_b, dot) alone."""
    a, b = (scores.select(*unit, F.col("axis").alias(f"axis_{k}"), F.col("score").alias(f"s{k}")) for k in "ab")
    return a.join(b, unit).join(basis_gram, ["axis_a", "axis_b"]).groupBy(*unit).agg(F.sum(F.col("sa") * F.col("dot") * F.col("sb")).alias("norm"))


def operator_similarity(packed: DataFrame, name: str) -> DataFrame:
    """a < b -> cosine of packed operators(name, xs). The names are an axis of the design; each array crosses once for every other."""
    a, b = (packed.select(F.col(name).alias(k), F.col("xs").alias(f"x{k}")) for k in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", safe_ratio(dot("xa", "xb"), F.sqrt(dot("xa", "xa") * dot("xb", "xb"))).alias("cosine"))


def precision_gate(df: DataFrame, limit: float) -> DataFrame:
    """Largest difference of cells' squared norms in single and double precision, relative to the norm, and whether it is within the limit."""
    x = F.col("value")
    g = df.groupBy("replicate", "context").agg(F.sum(x * x).alias("d"), F.sum((x.cast("float") * x.cast("float")).cast("double")).alias("f"))
    return g.agg(F.max(safe_ratio(F.abs(F.col("d") - F.col("f")), F.abs("d"))).alias("worst")).select("worst", (F.col("worst") <= limit).alias("passed"))


def span_basis(loadings: DataFrame) -> DataFrame:
    """axis, feature, weight -> an orthonormal basis of the axes' span, by singular vectors; axes are few, features of a program some thousand at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="axis", columns="feature", values="weight").fillna(0.0).sort_index()
        _, s, vt = np.linalg.svd(m.to_numpy(float), full_matrices=False)
        vt = vt[s > 1e-10 * s.max()] if len(s) and s.max() > 0 else vt[:0]
        vt = vt * np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(1)] < 0, -1, 1)[:, None]
        return pd.DataFrame([(k, f, w) for k, row in enumerate(vt) for f, w in zip(m.columns, row)], columns=["axis", "feature", "weight"])

    return loadings.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda pdf: run(pdf), "axis int, feature string, weight double")


def kernel_weights(gram: DataFrame, alpha: float) -> DataFrame:
    """context, source, weight: kernel ridge on a Gram(ctx_a, ctx_b, dot), then moved to sum to one. A task holds one context's Gram."""
    held = gram.select(F.col("ctx_a").alias("context")).distinct()
    pairs = held.join(gram, F.col("ctx_a") != F.col("context"))  # the design's contexts, each against the rest

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="ctx_a", columns="ctx_b", values="dot").sort_index()
        names = list(m.index)
        k = m[names].to_numpy(float)
        scale = max(np.trace(k) / len(names), 1e-12)
        w = np.linalg.solve(k / scale + alpha * np.eye(len(names)), m[key[0]].to_numpy(float) / scale)
        return pd.DataFrame({"context": key[0], "source": names, "weight": w + (1 - w.sum()) / len(names)})

    return pairs.groupBy("context").applyInPandas(solve, "context string, source string, weight double")


def free_weights(gram: np.ndarray, cross: np.ndarray, ridge: float) -> np.ndarray:
    """Weights without a constraint: least w'Gw - 2 w'c + ridge * trace(G)/n * |w|^2."""
    n = len(cross)
    return np.linalg.solve(gram + ridge * max(np.trace(gram) / n, 1e-12) * np.eye(n), cross)


def _fold_grams(pdf: pd.DataFrame, context: str) -> tuple[list[str], dict]:
    """Sources, and each (fold, part)'s Gram with the context first; an error where a pair comes twice."""
    names = sorted(set(pdf.ctx_a) - {context})
    full = [context, *names]
    grams = {}
    for key, g in pdf.groupby(["hidden", "part"]):
        m = g.pivot(index="ctx_a", columns="ctx_b", values="dot").reindex(index=full, columns=full)
        grams[key] = m.fillna(m.T).to_numpy(float)
    return names, grams


def nested_penalty(fold_grams: DataFrame, ridges: list[float], form: str = "affine") -> DataFrame:
    """context, ridge, error, picked: the penalty of each context's weights by inner folds; form is affine (weights sum to one) or free.

    fold_grams(hidden, part, ctx_a, ctx_b, dot): for each inner fold the Gram of the other folds (part 'fit') and its own
    ('test'). Weights see the first only and are scored on the second; ties go to the larger penalty. A task holds one context.
    """
    from .models import affine_weights

    solve = {"affine": affine_weights, "free": free_weights}[form]
    held = fold_grams.select(F.col("ctx_a").alias("context")).distinct()
    both = held.join(fold_grams, (F.col("ctx_a") == F.col("context")) | (F.col("ctx_b") != F.col("context")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, grams = _fold_grams(pdf, key[0])
        rows = []
        for ridge in ridges:
            error = 0.0
            for fold in sorted({k[0] for k in grams}):
                fit, test = grams[fold, "fit"], grams[fold, "test"]
                w = np.append(-1.0, solve(fit[1:, 1:], fit[1:, 0], ridge))
                error += float(w @ test @ w)
            rows.append((key[0], ridge, error))
        out = pd.DataFrame(rows, columns=["context", "ridge", "error"])
        best = max(out.itertuples(), key=lambda r: (-round(r.error, 9), r.ridge)).ridge
        return out.assign(picked=out.ridge == best)

    return both.groupBy("context").applyInPandas(run, "context string, ridge double, error double, picked boolean")


def episode_choices(fold_grams: DataFrame, ridges: list[float], ranks: list[int], pulls: list[float]) -> DataFrame:
    """context, ridge, rank, pull, error, picked: the choice of a context's weights over three axes by inner folds.

    Affine weights at a ridge, their deviation from equal weights kept in the rank leading axes of the centred Gram, then pulled
    towards equal weights: (1 - pull) w + pull / n. One factorisation a fold serves all ranks. Ties go to the smaller rank, the
    larger ridge, the larger pull. A task holds one context.
    """
    from .models import affine_weights

    held = fold_grams.select(F.col("ctx_a").alias("context")).distinct()
    both = held.join(fold_grams, (F.col("ctx_a") == F.col("context")) | (F.col("ctx_b") != F.col("context")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, grams = _fold_grams(pdf, key[0])
        n, error = len(names), {}
        h = np.eye(n) - 1 / n
        for fold in sorted({k[0] for k in grams}):
            fit, test = grams[fold, "fit"], grams[fold, "test"]
            axes = np.linalg.eigh(h @ fit[1:, 1:] @ h)[1][:, ::-1]
            for ridge in ridges:
                along = axes.T @ (affine_weights(fit[1:, 1:], fit[1:, 0], ridge) - 1 / n)
                for rank in ranks:
                    bent = h @ (axes[:, :rank] @ along[:rank])  # still sums to nothing
                    for pull in pulls:
                        w = np.append(-1.0, 1 / n + (1 - pull) * bent)
                        error[ridge, rank, pull] = error.get((ridge, rank, pull), 0.0) + float(w @ test @ w)
        best = min(error, key=lambda c: (round(error[c], 9), c[1], -c[0], -c[2]))
        return pd.DataFrame([(key[0], *c, e, c == best) for c, e in error.items()], columns=["context", "ridge", "rank", "pull", "error", "picked"])

    return both.groupBy("context").applyInPandas(run, "context string, ridge double, rank int, pull double, error double, picked boolean")


def by_fold(df: DataFrame, folds: DataFrame) -> DataFrame:
    """hidden, part, ctx_a, ctx_b, dot: context Grams of each fold's interventions ('test') and of all others ('fit')."""
    from .interaction import gram

    g = gram(df).filter("rep_a = rep_b").join(folds, "intervention").groupBy("fold", "ctx_a", "ctx_b").agg(F.sum("dot").alias("own"))
    g = g.withColumn("all", F.sum("own").over(Window.partitionBy("ctx_a", "ctx_b")))  # a row a fold
    kind = F.inline(F.array(F.struct(F.lit("test").alias("part"), F.col("own").alias("dot")), F.struct(F.lit("fit").alias("part"), (F.col("all") - F.col("own")).alias("dot"))))
    return g.select(F.col("fold").alias("hidden"), "ctx_a", "ctx_b", kind)
