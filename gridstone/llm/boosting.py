"""Gradient-boosted trees of depth two, fitted on the driver and evaluated as a Column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _stump(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    g, h = grad.sum(), hess.sum()
    for j, values in enumerate(cuts):
        for t in values:
            left = x[:, j] <= t
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, j, float(t))
    return best


def _leaf(grad: np.ndarray, hess: np.ndarray, rate: float) -> float:
    return float(-rate * grad.sum() / (hess.sum() + 1))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, rate: float = 0.3) -> list[tuple]:
    """Trees as (feature, cut, left, right), a side being such a tuple or a value; logistic loss, second order."""
    cuts = [(lambda u: (u[:-1] + u[1:]) / 2 if len(u) <= 24 else np.quantile(x[:, j], np.linspace(0.04, 0.96, 24)))(np.unique(x[:, j])) for j in range(x.shape[1])]
    score, made = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        _, j, t = _stump(x, grad, hess, cuts)
        if j < 0:
            break
        sides = []
        for rows in (x[:, j] <= t, x[:, j] > t):
            _, k, u = _stump(x[rows], grad[rows], hess[rows], cuts)
            if k < 0:
                sides.append(_leaf(grad[rows], hess[rows], rate))
            else:
                low = rows & (x[:, k] <= u)
                high = rows & (x[:, k] > u)
                sides.append((k, u, _leaf(grad[low], hess[low], rate), _leaf(grad[high], hess[high], rate)))
        made.append((j, t, *sides))
        score += predict([made[-1]], x)
    return made


def predict(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    def side(node, rows):
        return np.full(len(rows), node) if not isinstance(node, tuple) else np.where(rows[:, node[0]] <= node[1], side(node[2], rows), side(node[3], rows))

    return sum((side(t, x) for t in trees), np.zeros(len(x)))


def column(trees: list[tuple], feature) -> Column:
    """The score as a Column; feature(j) is the j-th feature's Column."""

    def side(node) -> Column:
        return F.when(feature(node[0]) <= node[1], side(node[2])).otherwise(side(node[3])) if isinstance(node, tuple) else F.lit(node)

    total = F.lit(0.0)
    for tree in trees:
        total = total + side(tree)
    return total


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a * score + b))), by Newton steps."""
    a, b = 1.0, 0.0
    design = np.stack([score, np.ones_like(score)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        grad = design.T @ (p - y) + 1e-3 * np.array([a - 1, b])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)
