"""Non-negative response programs over rows of any number: fit, transform, reconstruct, and how stable they are.

X = W H with H of programs by features. A pass solves the rows' W for the H at hand inside
tasks and sums W'X and W'W over them; the driver updates H from these programs-by-features
numbers. No row is kept, none leaves its task, and new rows are transformed by H alone.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subspace import stacked, summed

TINY = 1e-12


def loadings(x: np.ndarray, h: np.ndarray, steps: int) -> np.ndarray:
    """W >= 0 of rows for a given H, by multiplicative updates from equal weights."""
    w, hh, xh = np.full((len(x), len(h)), 1.0), h @ h.T, x @ h.T
    for _ in range(steps):
        w *= xh / (w @ hh + TINY)
    return w


def fit_programs(rows: DataFrame, programs: int, passes: int = 40, inner: int = 30, seed: int = 0) -> np.ndarray:
    """H of non-negative rows(x array<double>); programs have unit norm and are ordered by their first feature's share, then the next. Negative values count as 0."""
    size = rows.select(F.max(F.size("x"))).first()[0]
    if not size or size * programs > 10_000_000:
        raise ValueError(f"{size} features by {programs} programs")
    h = np.random.default_rng(seed).random((programs, size)) + 0.1

    def sums(x: np.ndarray, h=None) -> np.ndarray:
        x = np.maximum(x, 0)
        w = loadings(x, h, inner)
        return np.hstack([w.T @ x, w.T @ w])

    for _ in range(passes):
        m = summed(rows, lambda x, h=h: sums(x, h))
        wx, ww = m[:, :size], m[:, size:]
        for _ in range(5):
            h *= wx / (ww @ h + TINY)
        h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), TINY)
    return h[np.lexsort(h.T[::-1])[::-1]]


def transform(rows: DataFrame, h: np.ndarray, inner: int = 200) -> DataFrame:
    """rows with x replaced by weights array<double> and error, the squared error of the row's reconstruction. Any rows: none enters a fit."""
    others = [c for c in rows.columns if c not in ("x", "weights", "error")]
    used = rows.select(F.struct(*others).alias("__row"), F.col("x"))

    def run(batches):
        for batch in batches:
            x = np.maximum(stacked(batch.column(1)), 0) if batch.num_rows else np.zeros((0, h.shape[1]))
            w = loadings(x, h, inner)
            at = pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(w.ravel())), pa.array(((x - w @ h) ** 2).sum(1))], ["__row", "weights", "error"])

    return used.mapInArrow(run, f"__row {used.schema['__row'].dataType.simpleString()}, weights array<double>, error double").select("__row.*", "weights", "error")


def matched_programs(a: np.ndarray, b: np.ndarray) -> tuple[list[int], np.ndarray]:
    """For each program of a its partner in b, and their cosines: the assignment with the largest sum, by trying all (8 programs at most)."""
    if len(a) != len(b) or len(a) > 8:
        raise ValueError("as many programs on both sides, 8 at most")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), TINY)
    cos = unit(a) @ unit(b).T
    best = max(permutations(range(len(b))), key=lambda p: (round(float(cos[np.arange(len(a)), list(p)].sum()), 12), [-i for i in p]))
    return list(best), cos[np.arange(len(a)), list(best)]


def stability(rows: DataFrame, programs: int, seeds: list[int], **more) -> DataFrame:
    """seed, program, partner, cosine: programs fitted from each further seed, matched to those of the first."""
    first = fit_programs(rows, programs, seed=seeds[0], **more)
    out = []
    for s in seeds[1:]:
        partner, cos = matched_programs(first, fit_programs(rows, programs, seed=s, **more))
        out += [(s, k, int(p), float(c)) for k, (p, c) in enumerate(zip(partner, cos))]
    return rows.sparkSession.createDataFrame(out, "seed int, program int, partner int, cosine double")
