"""Nested choices of dimension, penalty and kernel width, and refit nulls, on an axis of units.

units(unit, x array<double>, y array<double>) are rows of a design (contexts, patients):
some thousand at most, so that one fold's Gram fits a task. Work is dealt by outer and inner
fold; a task factorises its training Gram once, and every dimension and penalty comes from
that. Scores are added up and chosen among by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf.x.to_numpy()).astype(float), np.stack(pdf.y.to_numpy()).astype(float)


def standardised(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by the training mean and deviation; features without any spread in training are left out."""
    m, s = train.mean(0), train.std(0)
    keep = s > 1e-12
    return (train[:, keep] - m[keep]) / s[keep], (test[:, keep] - m[keep]) / s[keep]


def scores(train: np.ndarray, test: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Principal scores of centred rows, from the training Gram alone, in falling order."""
    values, vectors = np.linalg.eigh(train @ train.T)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > TOLERANCE * max(values.max(), 1e-300)][:most]
    s = np.sqrt(values[order])
    return vectors[:, order] * s, (test @ train.T @ vectors[:, order]) / s


def ridge_paths(train: np.ndarray, test: np.ndarray, y: np.ndarray, alphas: list[float], dims: list[int]) -> dict[tuple[int, float], np.ndarray]:
    """(k, alpha) -> predictions of test: ridge on the first k scores, all of them from one factorisation. Dimensions above the rank use all there are."""
    a, b = scores(train, test)
    mean = y.mean(0)
    lam, along = (a**2).sum(0), a.T @ (y - mean)
    out = {}
    for alpha in alphas:
        step = (b / (lam + alpha))[:, :, None] * along[None, :, :]
        upto = np.concatenate([np.zeros((len(test), 1, y.shape[1])), np.cumsum(step, 1)], 1)
        for k in dims:
            out[k, alpha] = mean + upto[:, min(k, len(lam))]
    return out


def rbf_paths(train: np.ndarray, test: np.ndarray, y: np.ndarray, alphas: list[float], dims: list[int], widths: list[float]) -> dict[tuple[int, float, float], np.ndarray]:
    """(k, alpha, width) -> predictions by kernel ridge on the first k scores; widths are multiples of the median squared training distance. One factorisation a kernel serves all penalties."""
    a, b = scores(train, test)
    mean, out = y.mean(0), {}
    sq = lambda p, q: np.maximum((p**2).sum(1)[:, None] + (q**2).sum(1) - 2 * p @ q.T, 0)
    for k in dims:
        d, e = sq(a[:, :k], a[:, :k]), sq(b[:, :k], a[:, :k])
        off = d[~np.eye(len(d), dtype=bool)]
        middle = float(np.median(off)) if len(off) and np.median(off) > 0 else 1.0
        for width in widths:
            values, vectors = np.linalg.eigh(np.exp(-d / (width * middle)))
            along, cross = vectors.T @ (y - mean), np.exp(-e / (width * middle)) @ vectors
            for alpha in alphas:
                out[k, alpha, width] = mean + (cross / (values + alpha)) @ along
    return out


def _paths(train, test, y, alphas, dims, widths):
    z, t = standardised(train, test)
    out = {(k, a, 0.0): p for (k, a), p in ridge_paths(z, t, y, alphas, dims).items()}
    return out | (rbf_paths(z, t, y, alphas, dims, widths) if widths else {})


def nested_errors(units: DataFrame, folds: DataFrame, alphas: list[float], dims: list[int], widths: list[float] | None = None) -> DataFrame:
    """outer, k, alpha, width, error, n: squared error of every choice over the inner folds of each outer fold, outer rows left out before any arithmetic. width 0 is linear.

    folds(unit, fold): the inner folds of an outer one are the other folds. A task holds one pair of folds' rows.
    """
    rows = units.join(folds, "unit")
    every = folds.select("fold").distinct()
    pairs = every.select(F.col("fold").alias("outer")).join(every.select(F.col("fold").alias("inner")), F.col("outer") != F.col("inner"))  # folds are few
    both = F.broadcast(pairs).join(rows, F.col("fold") != F.col("outer"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        (x, y), test = matrices(pdf), (pdf.fold == key[1]).to_numpy()
        found = _paths(x[~test], x[test], y[~test], alphas, dims, widths)
        return pd.DataFrame([(key[0], *choice, float(((p - y[test]) ** 2).sum()), int(test.sum())) for choice, p in found.items()], columns=["outer", "k", "alpha", "width", "error", "n"])

    each = both.groupBy("outer", "inner").applyInPandas(run, "outer int, k int, alpha double, width double, error double, n long")
    return each.groupBy("outer", "k", "alpha", "width").agg(F.sum("error").alias("error"), F.sum("n").alias("n"))


def chosen(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """outer (and the columns by, as for the best penalty of each k) -> k, alpha, width, error: least error to nine digits; ties to the smaller k, the larger penalty, the linear form."""
    keys = ["outer", *(by or [])]
    best = F.min_by(F.struct("k", "alpha", "width", "error"), F.struct(F.round("error", 9), "k", -F.col("alpha"), "width"))
    return errors.groupBy(*keys).agg(best.alias("__b")).select(*keys, *(F.col(f"__b.{c}").alias(c) for c in ("k", "alpha", "width", "error") if c not in keys))


def nested_predictions(units: DataFrame, folds: DataFrame, picks: DataFrame) -> DataFrame:
    """outer, unit, output, y, prediction, population (the training mean), k, alpha, width: each outer fold with its pick, fitted on all other folds."""
    rows = units.join(folds, "unit").join(F.broadcast(picks.select("outer", "k", "alpha", "width")))  # a row a fold

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        (x, y), test = matrices(pdf), (pdf.fold == key[0]).to_numpy()
        k, alpha, width = int(pdf.k.iloc[0]), float(pdf.alpha.iloc[0]), float(pdf.width.iloc[0])
        p = _paths(x[~test], x[test], y[~test], [alpha], [k], [width] if width else [])[k, alpha, width]
        mean = y[~test].mean(0)
        out = [(key[0], u, o, float(y[test][i, o]), float(p[i, o]), float(mean[o]), k, alpha, width) for i, u in enumerate(pdf.unit[test]) for o in range(y.shape[1])]
        return pd.DataFrame(out, columns=["outer", "unit", "output", "y", "prediction", "population", "k", "alpha", "width"])

    kind = units.schema["unit"].dataType.simpleString()
    return rows.groupBy("outer").applyInPandas(run, f"outer int, unit {kind}, output int, y double, prediction double, population double, k int, alpha double, width double")


def variance_captured(units: DataFrame, folds: DataFrame, dims: list[int]) -> DataFrame:
    """outer, k, share: how much of the standardised training variance the first k axes hold."""
    every = folds.select(F.col("fold").alias("outer")).distinct()
    rows = units.join(folds, "unit").join(F.broadcast(every), F.col("fold") != F.col("outer"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, _ = matrices(pdf.sort_values("unit"))
        z, _ = standardised(x, x)
        values = np.sort(np.linalg.eigvalsh(z @ z.T))[::-1]
        upto = np.concatenate([[0], np.cumsum(np.maximum(values, 0))])
        return pd.DataFrame([(key[0], k, float(upto[min(k, len(values))] / max(upto[-1], 1e-300))) for k in dims], columns=["outer", "k", "share"])

    return rows.groupBy("outer").applyInPandas(run, "outer int, k int, share double")


def refit_nulls(units: DataFrame, folds: DataFrame, alpha: float, draws: int, seed: int = 0) -> DataFrame:
    """family, draw, outer, unit, output, y, prediction, population: ridge fits of every outer fold on shuffled training rows.

    Families: 'baseline' shuffles which training row has which features, 'response' which has which responses; draw 0 of either
    is the unshuffled fit. Each fold is factorised once: a shuffle of rows permutes the factor, and costs two products.
    """
    every = folds.select(F.col("fold").alias("outer")).distinct()
    rows = units.join(folds, "unit").join(F.broadcast(every))  # folds are few

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        (x, y), test = matrices(pdf), (pdf.fold == key[0]).to_numpy()
        z, t = standardised(x[~test], x[test])
        values, vectors = np.linalg.eigh(z @ z.T)
        cross, mean = (t @ z.T @ vectors) / (values + alpha), y[~test].mean(0)
        rest, names, parts = y[~test] - mean, pdf.unit[test].tolist(), []
        for draw in range(draws + 1):
            rnd = np.random.default_rng([seed, draw, int(key[0])])
            order = rnd.permutation(len(rest)), rnd.permutation(len(rest))
            for family, p in zip(("baseline", "response"), order):
                if draw == 0:
                    p = np.arange(len(rest))
                # rows of the factor, or of the responses
                pred = mean + (cross @ vectors[p].T @ rest if family == "baseline" else cross @ vectors.T @ rest[p])
                n, o = pred.shape
                parts.append(pd.DataFrame({"family": family, "draw": draw, "outer": key[0], "unit": np.repeat(names, o), "output": np.tile(np.arange(o), n), "y": y[test].ravel(), "prediction": pred.ravel(), "population": np.tile(mean, n)}))
        return pd.concat(parts, ignore_index=True)

    kind = units.schema["unit"].dataType.simpleString()
    return rows.groupBy("outer").applyInPandas(run, f"family string, draw int, outer int, unit {kind}, output int, y double, prediction double, population double")


def gain_null(predictions: DataFrame) -> DataFrame:
    """family -> observed gain over the population mean (1 - error / population's error), its mean and 95th percentile over shuffled draws, and p."""
    from ..functions.expr import at_least, safe_ratio

    err = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    g = predictions.groupBy("family", "draw").agg((1 - safe_ratio(F.sum(err("prediction")), F.sum(err("population")))).alias("gain"))
    seen = g.filter("draw = 0").select("family", F.col("gain").alias("observed"))
    return g.filter("draw > 0").join(seen, "family").groupBy("family", "observed").agg(F.avg("gain").alias("mean"), F.percentile("gain", 0.95).alias("p95"), ((1 + F.count_if(at_least(F.col("gain"), F.col("observed")))) / (1 + F.count(F.lit(1)))).alias("p"))
