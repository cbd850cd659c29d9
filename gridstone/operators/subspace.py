"""Principal axes of rows that lie over many tasks, fitted on training rows only.

A randomised range finder whose every pass is a sum over rows: with Q of features by q
columns, a task adds up its rows' x'(xQ), a Spark aggregate adds up the tasks, and only
features by q numbers come back for a QR. After the last pass the q by q matrix of (xQ)'(xQ)
gives the axes. Rows are read once a pass and never held together; held-out rows are only
projected. Features and axes are axes of the design: MOST_NUMBERS of their product is the
bound of what a driver or a task holds, and more is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NUMBERS = 50_000_000


@dataclass(frozen=True)
class Axes:
    """components (axes by features), the training mean, the axes' training energy and that of all."""

    components: np.ndarray
    mean: np.ndarray
    energy: np.ndarray
    total: float
    rows: int


def stacked(column: pa.Array) -> np.ndarray:
    """An array<double> column as a matrix; an error where rows differ in length or hold nulls."""
    flat = column.flatten()
    if column.null_count or flat.null_count or len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("rows must be arrays of one length without nulls")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over rows(x array<double>) of make(block of rows): added up in tasks, then by a Spark aggregate; a matrix comes back."""

    def run(batches):
        total = None
        for batch in batches:
            x = stacked(batch.column(0))
            if len(x):
                total = make(x) if total is None else total + make(x)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    cells = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(cells):
        raise ValueError("no rows to fit")
    out = np.zeros((cells.i.max() + 1, cells.j.max() + 1))
    out[cells.i, cells.j] = cells.v
    return out


def fit_axes(rows: DataFrame, rank: int, oversample: int = 10, passes: int = 3, seed: int = 0) -> Axes:
    """The leading axes of training rows(x array<double>), centred by their own mean; an axis's largest loading is positive."""
    low, high = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise ValueError(f"rows of {low} to {high} features")
    first = summed(rows, lambda x: np.concatenate([x.sum(0), [len(x)]])[None, :])[0]
    n, mean = first[-1], first[:-1] / first[-1]
    p = len(mean)
    q = int(min(rank + oversample, p, n))
    if p * q > MOST_NUMBERS:
        raise ValueError(f"{p} features by {q} axes are more than {MOST_NUMBERS} numbers")
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, q)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(summed(rows, lambda x, b=basis: (x - mean).T @ ((x - mean) @ b)))[0]
    # the q by q products, and below them the energy of all
    last = summed(rows, lambda x, b=basis: np.vstack([((x - mean) @ b).T @ ((x - mean) @ b), np.full((1, q), ((x - mean) ** 2).sum())]))
    values, vectors = np.linalg.eigh((last[:q] + last[:q].T) / 2)
    order = np.argsort(-values, kind="stable")[:rank]
    components = (basis @ vectors[:, order]).T
    components *= np.where(components[np.arange(len(order)), np.abs(components).argmax(1)] < 0, -1, 1)[:, None]
    return Axes(components, mean, np.maximum(values[order], 0), float(last[q, 0]), int(n))


def project(rows: DataFrame, axes: Axes) -> DataFrame:
    """rows with x replaced by scores array<double>: the axes' coordinates of the row less the training mean."""
    others = [c for c in rows.columns if c not in ("x", "scores")]
    used = rows.select(F.struct(*others).alias("__row"), F.col("x"))

    def run(batches):
        for batch in batches:
            s = (stacked(batch.column(1)) - axes.mean) @ axes.components.T if batch.num_rows else np.zeros((0, len(axes.components)))
            at = np.arange(len(s) + 1, dtype=np.int32) * len(axes.components)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(s.ravel()))], ["__row", "scores"])

    return used.mapInArrow(run, f"__row {used.schema['__row'].dataType.simpleString()}, scores array<double>").select("__row.*", "scores")


def residual(rows: DataFrame, axes: Axes) -> DataFrame:
    """rows with x less the training mean and less its part along the axes."""
    others = [c for c in rows.columns if c != "x"]
    used = rows.select(F.struct(*others).alias("__row"), F.col("x"))

    def run(batches):
        for batch in batches:
            z = stacked(batch.column(1)) - axes.mean if batch.num_rows else np.zeros((0, len(axes.mean)))
            z = z - (z @ axes.components.T) @ axes.components
            at = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(z.ravel()))], ["__row", "x"])

    return used.mapInArrow(run, f"__row {used.schema['__row'].dataType.simpleString()}, x array<double>").select("__row.*", "x")


def fidelity(rows: DataFrame, axes: Axes, keys: list[str]) -> DataFrame:
    """keys, axis, energy, share, upto: how much of the rows' energy about the training mean each axis holds, the share of the axes up to it, and what is left of all (axis null): the identity energy = sum of axes + left."""
    sq = rows.select(*keys, "x")
    scored = project(sq.withColumn("__x", F.col("x")), axes)
    mean = F.array(*(F.lit(float(v)) for v in axes.mean)) if len(axes.mean) <= 4096 else None
    if mean is None:
        raise ValueError("too many features for one array of means")
    whole = F.aggregate(F.zip_with("__x", mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    total = scored.groupBy(*keys).agg(F.sum(whole).alias("total"))
    each = scored.select(*keys, F.posexplode("scores").alias("axis", "s")).groupBy(*keys, "axis").agg(F.sum(F.col("s") * F.col("s")).alias("energy"))
    both = each.join(total, keys)
    before = both.alias("a").join(each.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("b.axis") <= F.col("a.axis")])
    upto = before.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.axis").alias("axis"), F.col("a.energy").alias("energy"), F.col("a.total").alias("total")).agg(F.sum("b.energy").alias("held"))
    return upto.select(*keys, "axis", "energy", (F.col("energy") / F.col("total")).alias("share"), (F.col("held") / F.col("total")).alias("upto"), (F.col("total") - F.col("held")).alias("left"))


def packed_rows(df: DataFrame, keys: list[str], names: list[str], value: str) -> DataFrame:
    """keys, x: the values of a long table side by side, in the order of their names; rows that lack a name are an error in fit_axes."""
    held = F.sort_array(F.collect_list(F.struct(*names, F.col(value).alias("__v"))))
    return df.groupBy(*keys).agg(F.transform(held, lambda s: s["__v"]).alias("x"))
