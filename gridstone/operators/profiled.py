"""Low-rank interactions with everything linear profiled out.

Cells (context, intervention) have a row of features each. The model of a cell is an additive
part, free for every feature, plus the sum over ranks of u(context) v(intervention) times a
loading of the feature. For given u and v, loadings are a ridge solution; the additive part
goes out by projection (Frisch-Waugh), of the features once and of the products u v at every
step. What is left is a smooth function of u and v, minimised by L-BFGS with its exact
gradient from several starts. A task holds one fold's seen cells; hidden ones never enter it
before the prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Profile:
    """The profiled objective over seen cells i, j with features y, and what follows from a solution."""

    def __init__(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, sizes: tuple[int, int], rank: int, ridge: float):
        self.i, self.j, self.sizes, self.rank, self.ridge = i, j, sizes, rank, ridge
        self.x = self.design(i, j)
        self.basis = np.linalg.svd(self.x, full_matrices=False)
        keep = self.basis[1] > 1e-9 * self.basis[1].max()
        self.span, self.y = self.basis[0][:, keep], y
        self.rest = self.apart(y)
        self.scale = max((self.rest**2).sum(), 1e-300)

    def design(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = np.zeros((len(i), sum(self.sizes)))
        x[np.arange(len(i)), i] = x[np.arange(len(i)), self.sizes[0] + j] = 1
        return x

    def apart(self, m: np.ndarray) -> np.ndarray:
        """Without its part in the additive design."""
        return m - self.span @ (self.span.T @ m)

    def split(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.sizes
        u, v = theta[: a * self.rank].reshape(a, self.rank), theta[a * self.rank :].reshape(b, self.rank)
        return u - u.mean(0), v - v.mean(0)

    def loadings(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.apart(u[self.i] * v[self.j])
        normal = z.T @ z + self.ridge * len(z) * np.eye(self.rank)
        return z, np.linalg.solve(normal, z.T @ self.rest)

    def value(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Minus the share of energy explained, plus the penalty of the factors; and the gradient."""
        u, v = self.split(theta)
        z, w = self.loadings(u, v)
        f = -float((w * (z.T @ self.rest)).sum()) / self.scale + self.ridge * ((u**2).mean() + (v**2).mean())
        g = -2 * ((self.rest - z @ w) @ w.T) / self.scale  # by z; it needs no second projection
        gu, gv = 2 * self.ridge * u / u.size, 2 * self.ridge * v / v.size
        np.add.at(gu, self.i, g * v[self.j])
        np.add.at(gv, self.j, g * u[self.i])
        return f, np.concatenate([(gu - gu.mean(0)).ravel(), (gv - gv.mean(0)).ravel()])

    def predict(self, theta: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Additive part alone and the whole model, for any cells."""
        left, s, right = self.basis
        inverse = np.where(s > 1e-9 * s.max(), 1 / np.maximum(s, 1e-300), 0)
        additive = lambda m: self.design(i, j) @ (right.T @ (inverse[:, None] * (left.T @ m)))
        u, v = self.split(theta)
        _, w = self.loadings(u, v)
        return additive(self.y), additive(self.y - (u[self.i] * v[self.j]) @ w) + (u[i] * v[j]) @ w


def minimised(value, theta: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> tuple[np.ndarray, float, float, int]:
    """L-BFGS with step halving: the point, its value, its gradient's norm and the steps taken."""
    f, g = value(theta)
    s, y, step = [], [], 0
    for step in range(1, steps + 1):
        if np.linalg.norm(g) <= tolerance:
            return theta, f, float(np.linalg.norm(g)), step - 1
        q, held = g.copy(), []
        for a, b in zip(reversed(s), reversed(y)):
            c = (a @ q) / (a @ b)
            held.append(c)
            q -= c * b
        q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1]) if s else 1 / max(np.linalg.norm(g), 1)
        for a, b, c in zip(s, y, reversed(held)):
            q += (c - (b @ q) / (a @ b)) * a
        if q @ g <= 0:
            q, s, y = g, [], []
        t = 1.0
        while True:
            new = theta - t * q
            fn, gn = value(new)
            if fn <= f - 1e-4 * t * (q @ g) or t < 1e-12:
                break
            t /= 2
        if t < 1e-12:
            return theta, f, float(np.linalg.norm(g)), step
        if (gn - g) @ (new - theta) > 1e-14:
            s, y = [*s, new - theta][-memory:], [*y, gn - g][-memory:]
        theta, f, g = new, fn, gn
    return theta, f, float(np.linalg.norm(g)), step


def fit_profile(profile: Profile, starts: int, seed: int, steps: int = 2000, tolerance: float = 1e-7) -> tuple[np.ndarray, list[tuple[float, float, int]]]:
    """The best point of several starts, and each start's value, gradient norm and steps."""
    out = []
    for k in range(starts):
        theta = np.random.default_rng([seed, k]).normal(0, 0.5, sum(profile.sizes) * profile.rank)
        out.append(minimised(profile.value, theta, steps, tolerance))
    best = min(out, key=lambda o: o[1])
    return best[0], [o[1:] for o in out]


def profiled_completion(df: DataFrame, folds: DataFrame, rank: int, ridge: float, starts: int = 2, seed: int = 0) -> DataFrame:
    """replicate, context, intervention, feature, fold, value, additive, prediction, converged, spread: held-out cells of every fold.

    df(replicate, context, intervention, feature, value), folds(context, intervention, fold). converged: the best start's gradient
    norm is below 1e-6; spread: how far the starts' values lie apart. Contexts, interventions and features are axes of the design.
    """
    held = F.sort_array(F.collect_list(F.struct("feature", "value")))
    cells = df.groupBy("replicate", "context", "intervention").agg(held.alias("h"))
    cells = cells.select("replicate", "context", "intervention", F.transform("h", lambda s: s["feature"]).alias("features"), F.transform("h", lambda s: s["value"]).alias("xs"))
    every = folds.select(F.col("fold").alias("hidden")).distinct()
    both = cells.join(folds, ["context", "intervention"]).join(F.broadcast(every))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["context", "intervention"]).reset_index(drop=True)
        names = sorted({f for fs in pdf["features"] for f in fs})
        full = (pdf["features"].map(len) == len(names)).to_numpy()
        pdf = pdf[full].reset_index(drop=True)  # a cell without some feature has no row to fit or predict
        cs, ps = sorted(pdf.context.unique()), sorted(pdf.intervention.unique())
        i, j = pdf.context.map({c: k for k, c in enumerate(cs)}).to_numpy(), pdf.intervention.map({p: k for k, p in enumerate(ps)}).to_numpy()
        seen = (pdf.fold != key[1]).to_numpy()
        y = np.stack(pdf["xs"][seen].to_numpy()).astype(float)
        scale = np.maximum(y.std(0), 1e-12)  # of the seen cells, so that no feature rules the fit by its unit
        profile = Profile(i[seen], j[seen], y / scale, (len(cs), len(ps)), rank, ridge)
        theta, ends = fit_profile(profile, starts, seed)
        additive, whole = (p * scale for p in profile.predict(theta, i[~seen], j[~seen]))
        norm = min(ends)[1]
        spread = max(e[0] for e in ends) - min(e[0] for e in ends)
        out = []
        for n, row in enumerate(pdf[~seen].itertuples()):
            out += [(key[0], row.context, row.intervention, f, row.fold, float(row.xs[k]), float(additive[n, k]), float(whole[n, k]), bool(norm <= 1e-6), float(spread)) for k, f in enumerate(names)]
        return pd.DataFrame(out, columns=["replicate", "context", "intervention", "feature", "fold", "value", "additive", "prediction", "converged", "spread"])

    return both.groupBy("replicate", "hidden").applyInPandas(run, "replicate int, context string, intervention string, feature string, fold int, value double, additive double, prediction double, converged boolean, spread double")
