"""Dense decompositions of small axes, one group a task: PCA, NMF, CP, linkage, random bases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(pdf: pd.DataFrame, row: str, col: str, value: str) -> pd.DataFrame:
    """Rows by columns in sorted order, absent cells 0."""
    return pdf.pivot_table(index=row, columns=col, values=value, aggfunc="sum", fill_value=0.0).sort_index().sort_index(axis=1)


def pca(df: DataFrame, group: str, row: str, col: str, value: str, rank: int) -> DataFrame:
    """group, component, row, score, explained: centred PCA of each group's matrix; a component's largest loading is positive."""

    def run(key, pdf):
        m = matrix(pdf, row, col, value)
        x = m.to_numpy(float)
        u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        k = min(rank, len(s))
        sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])
        score = u[:, :k] * s[:k] * sign
        share = s[:k] ** 2 / max((s**2).sum(), 1e-300)
        return pd.DataFrame([(key[0], c, str(m.index[r]), float(score[r, c]), float(share[c])) for c in range(k) for r in range(len(m))], columns=["group", "component", "row", "score", "explained"])

    return df.groupBy(F.col(group).cast("string").alias("group")).applyInPandas(run, "group string, component int, row string, score double, explained double")


def eigenvalues(df: DataFrame, group: str, name: str, by: list[str], value: str) -> DataFrame:
    """group, component, eigenvalue: of the covariance of the names over by. Covariances are sums; a task holds one group's names by names."""
    a, b = (df.select(group, *by, F.col(name).alias(k), F.col(value).alias(f"v{k}")) for k in "ab")
    c = a.join(b, [group, *by]).groupBy(group, "a", "b").agg(F.covar_pop("va", "vb").alias("c"))

    def run(key, pdf):
        m = matrix(pdf, "a", "b", "c").to_numpy(float)
        v = np.linalg.eigvalsh((m + m.T) / 2)[::-1]
        return pd.DataFrame({"group": key[0], "component": np.arange(len(v)), "eigenvalue": v})

    return c.groupBy(F.col(group).cast("string").alias("group")).applyInPandas(run, "group string, component int, eigenvalue double")


def nmf(df: DataFrame, group: str, row: str, col: str, value: str, rank: int, steps: int = 300, seed: int = 0) -> DataFrame:
    """group, component, row, weight, error: non-negative factors by multiplicative updates; error is the relative residual."""

    def run(key, pdf):
        m = matrix(pdf, row, col, value)
        x = np.maximum(m.to_numpy(float), 0)
        rnd = np.random.default_rng(seed)
        w, h = rnd.random((x.shape[0], rank)) + 0.1, rnd.random((rank, x.shape[1])) + 0.1
        for _ in range(steps):
            h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
            w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
        scale = np.linalg.norm(h, axis=1)
        w = w * scale
        order = np.argsort(-w.sum(0), kind="stable")
        error = float(np.linalg.norm(x - (w / scale) @ h) / max(np.linalg.norm(x), 1e-300))
        return pd.DataFrame([(key[0], c, str(m.index[r]), float(w[r, k]), error) for c, k in enumerate(order) for r in range(len(m))], columns=["group", "component", "row", "weight", "error"])

    return df.groupBy(F.col(group).cast("string").alias("group")).applyInPandas(run, "group string, component int, row string, weight double, error double")


def complete_low_rank(df: DataFrame, folds: DataFrame, rank: int, ridge: float, steps: int = 50, seed: int = 0) -> DataFrame:
    """Held-out entries of context x intervention matrices, each fold hidden in turn: two-way means plus a low-rank part by alternating least squares.

    df(feature, context, intervention, value), folds(context, intervention, fold). Hidden entries never enter a fit.
    """
    every = folds.select(F.col("fold").alias("hidden")).distinct()
    both = df.join(folds, ["context", "intervention"]).join(F.broadcast(every))

    def run(key, pdf):
        pdf = pdf.sort_values(["context", "intervention"])  # sums in one order, whatever the partitioning
        cs, ps = sorted(pdf.context.unique()), sorted(pdf.intervention.unique())
        i, j = pdf.context.map({c: k for k, c in enumerate(cs)}).to_numpy(), pdf.intervention.map({p: k for k, p in enumerate(ps)}).to_numpy()
        y, seen = pdf.value.to_numpy(float), (pdf.fold != key[1]).to_numpy()
        design = np.zeros((len(y), len(cs) + len(ps)))
        design[np.arange(len(y)), i] = design[np.arange(len(y)), len(cs) + j] = 1
        additive = design @ np.linalg.lstsq(design[seen], y[seen], rcond=None)[0]
        rest = y - additive
        rnd = np.random.default_rng(seed)
        a, b = rnd.normal(size=(len(cs), rank)), rnd.normal(size=(len(ps), rank))
        eye = ridge * np.eye(rank)
        for _ in range(steps):
            for side, own, other, at, to in ((0, a, b, i, j), (1, b, a, j, i)):
                for k in range(len(own)):
                    rows = seen & (at == k)
                    z = other[to[rows]]
                    own[k] = np.linalg.solve(z.T @ z + eye, z.T @ rest[rows]) if rows.any() else 0
        out = pdf.loc[~seen, ["feature", "context", "intervention", "fold", "value"]].copy()
        out["additive"], out["prediction"] = additive[~seen], (additive + (a[i] * b[j]).sum(1))[~seen]
        return out

    return both.groupBy("feature", "hidden").applyInPandas(run, "feature string, context string, intervention string, fold int, value double, additive double, prediction double")


def linkage(distances: DataFrame, group: str, cut: float) -> DataFrame:
    """group, item, cluster: average-linkage clusters below a cut, from distances(group, a, b, d) of a small axis."""

    def run(key, pdf):
        names = sorted(set(pdf.a) | set(pdf.b))
        at = {n: k for k, n in enumerate(names)}
        d = np.full((len(names), len(names)), np.inf)
        for a, b, x in zip(pdf["a"], pdf["b"], pdf["d"]):
            d[at[a], at[b]] = d[at[b], at[a]] = x
        sets = [[k] for k in range(len(names))]
        while len(sets) > 1:
            best = min((float(np.mean(d[np.ix_(x, y)])), p, q) for p, x in enumerate(sets) for q, y in enumerate(sets) if p < q)
            if best[0] > cut:
                break
            sets[best[1]] += sets.pop(best[2])
        return pd.DataFrame([(key[0], names[k], c) for c, s in enumerate(sorted(map(sorted, sets))) for k in s], columns=["group", "item", "cluster"])

    return distances.groupBy(F.col(group).cast("string").alias("group")).applyInPandas(run, "group string, item string, cluster int")


def random_bases(spark, features: list[str], dims: int, draws: int, seed: int = 0) -> DataFrame:
    """draw, axis, feature, weight: orthonormal bases from seeded normal matrices."""

    def run(pdf):
        out = []
        for draw in pdf.draw:
            q, r = np.linalg.qr(np.random.default_rng([seed, int(draw)]).normal(size=(len(features), dims)))
            q = q * np.sign(np.diag(r))
            out += [(int(draw), k, f, float(q[i, k])) for k in range(dims) for i, f in enumerate(features)]
        return pd.DataFrame(out, columns=["draw", "axis", "feature", "weight"])

    return spark.range(draws).select(F.col("id").alias("draw")).mapInPandas(lambda it: (run(p) for p in it), "draw long, axis int, feature string, weight double")


def ridge_leave_one_out(df: DataFrame, alphas: list[float]) -> DataFrame:
    """held, output, prediction, alpha: ridge from x to every output with one unit held out, the penalty by inner leave-one-out error.

    df(unit, x array, y array): an axis of units. Each task fits one held-out unit, penalties in one eigendecomposition.
    """
    held = df.select(F.col("unit").alias("held"))
    both = held.join(df)

    def run(key, pdf):
        pdf = pdf.sort_values("unit")
        test = (pdf.unit == key[0]).to_numpy()
        x, y = np.stack(pdf.x.to_numpy()).astype(float), np.stack(pdf.y.to_numpy()).astype(float)
        mx, sx, my = x[~test].mean(0), x[~test].std(0), y[~test].mean(0)
        sx[sx <= 1e-12] = 1
        z, t = (x - mx) / sx, y - my
        k = z[~test] @ z[~test].T
        values, vectors = np.linalg.eigh(k)
        best = None
        for alpha in alphas:
            inv = (vectors / (values + alpha)) @ vectors.T
            coef = inv @ t[~test]
            loo = ((coef / np.diag(inv)[:, None]) ** 2).mean()
            if best is None or (loo, -alpha) < best[0]:
                best = ((loo, -alpha), alpha, coef)
        p = my + (z[test] @ z[~test].T) @ best[2]
        return pd.DataFrame([(key[0], o, float(p[0, o]), best[1]) for o in range(y.shape[1])], columns=["held", "output", "prediction", "alpha"])

    return both.groupBy("held").applyInPandas(run, "held string, output int, prediction double, alpha double")


def module_ladder(df: DataFrame, unit: list[str], cuts: list[float]) -> DataFrame:
    """cut, module, name, unit, score, explained: names joined into modules at each correlation distance, and the first principal score of each module's names over units.

    df(unit, name, value). Distances 1 - r come from sums over units; a task holds the names' distances, or one module's rows: names and units are axes of the design.
    """
    from .shrinkage import correlation

    key = F.concat_ws("|", *(F.col(u).cast("string") for u in unit))
    long = df.select(key.alias("unit"), "name", "value")
    a, b = (long.select("unit", F.col("name").alias(k), F.col("value").alias(f"v{k}")) for k in "ab")
    d = a.join(b, "unit").filter("a < b").groupBy("a", "b").agg((1 - F.coalesce(correlation("va", "vb"), F.lit(0.0))).alias("d"))
    parts = None
    for cut in cuts:
        c = linkage(d.withColumn("g", F.lit("all")), "g", cut).select(F.lit(float(cut)).alias("cut"), F.col("item").alias("name"), F.concat_ws("|", F.lit(str(cut)), F.col("cluster").cast("string")).alias("module"))
        parts = c if parts is None else parts.unionByName(c)
    sized = parts.groupBy("cut", "module").agg(F.count(F.lit(1)).alias("names"))
    score = pca(long.join(parts, "name"), "module", "unit", "name", "value", 1).select(F.col("group").alias("module"), F.col("row").alias("unit"), "score", "explained")
    return sized.join(score, "module").select("cut", "module", "names", "unit", "score", "explained")
