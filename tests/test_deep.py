"""Distributed axes, nested choices, boosting and the rest against plain NumPy; chunked sources by round trips."""

import json
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridstone.operators import boost, crossgram, families, leakage, profiled, ranks, shrinkage, subspace, tuning
from gridstone.plans import registry
from gridstone.sources import arrays, facts, rowgroups

SF = "/root/testdata/sf0.01"
RND = np.random.default_rng(5)


def rows_of(spark, x, **more):
    data = [(i, [float(v) for v in r], *(c[i] for c in more.values())) for i, r in enumerate(x)]
    kinds = "".join(f", {k} {'boolean' if isinstance(v[0], bool) else 'int'}" for k, v in more.items())
    return spark.createDataFrame(data, f"id int, x array<double>{kinds}").repartition(5)


# --- axes -----------------------------------------------------------------------------------


def test_axes_equal_svd_and_ignore_what_is_held_out(spark):
    x = RND.normal(size=(90, 4)) @ np.diag([9, 5, 3, 1.5]) @ RND.normal(size=(4, 12)) + 0.01 * RND.normal(size=(90, 12)) + 3
    train = [bool(i % 3) for i in range(90)]
    df = rows_of(spark, x, train=train)
    axes = subspace.fit_axes(df.filter("train"), 4)
    t = x[np.array(train)]
    _, s, vt = np.linalg.svd(t - t.mean(0), full_matrices=False)
    vt = vt[:4] * np.where(vt[np.arange(4), np.abs(vt[:4]).argmax(1)] < 0, -1, 1)[:, None]
    assert np.allclose(axes.components, vt, atol=1e-6) and np.allclose(axes.energy, s[:4] ** 2) and np.isclose(axes.total, (s**2).sum())
    got = {r.id: r.scores for r in subspace.project(df, axes).collect()}
    assert np.allclose([got[i] for i in range(90)], (x - t.mean(0)) @ vt.T, atol=1e-6)
    moved = x.copy()
    moved[~np.array(train)] += 100
    again = subspace.fit_axes(rows_of(spark, moved, train=train).filter("train"), 4)
    assert np.allclose(axes.components, again.components, atol=1e-9)


def test_fidelity_adds_up(spark):
    x = RND.normal(size=(40, 6))
    df = rows_of(spark, x, fold=[i % 2 for i in range(40)])
    axes = subspace.fit_axes(df.filter("fold = 0"), 6)
    out = subspace.fidelity(df, axes, ["fold"]).toPandas()
    for f in (0, 1):
        own = out[out.fold == f].sort_values("axis")
        total = ((x[f::2] - x[::2].mean(0)) ** 2).sum()
        assert np.isclose(own.energy.sum(), total) and np.isclose(own.upto.iloc[-1], 1) and np.allclose(own.left, total - own.energy.cumsum(), atol=1e-8)
    left = {r.id: r.x for r in subspace.residual(df, axes).collect()}
    assert np.allclose(list(left.values()), 0, atol=1e-8)


def test_axes_of_no_rows_or_ragged_rows_fail(spark):
    df = rows_of(spark, RND.normal(size=(4, 3)))
    with pytest.raises(ValueError):
        subspace.fit_axes(df.filter("id < 0"), 2)
    with pytest.raises(Exception):
        subspace.fit_axes(df.withColumn("x", F.when(F.col("id") == 1, F.array(F.lit(1.0))).otherwise(F.col("x"))), 2)


# --- nulls from products ------------------------------------------------------------------------


def test_term_plan_has_each_product_once(spark):
    units = spark.createDataFrame([(d, s) for d in range(4) for s in "abc"], "donor int, state string")
    plan = crossgram.term_plan(units).toPandas()
    assert len(plan[["donor_l", "state_l", "donor_r", "state_r"]].drop_duplicates()) == 54
    assert len(plan[["partition", "state_a", "state_b"]].drop_duplicates()) == 9
    assert np.allclose(plan.groupby(["partition", "state_a", "state_b"]).coefficient.sum(), 0)
    with pytest.raises(ValueError):
        crossgram.halves(units.filter("donor < 3"))


# --- nested choices and refits -------------------------------------------------------------------


def tuning_data(spark, n=24):
    x = RND.normal(size=(n, 9))
    y = x[:, :3] @ RND.normal(size=(3, 2)) + 0.3 * RND.normal(size=(n, 2))
    folds = [i % 4 for i in range(n)]
    units = spark.createDataFrame([(f"u{i:02d}", x[i].tolist(), y[i].tolist()) for i in range(n)], "unit string, x array<double>, y array<double>")
    return x, y, np.array(folds), units, spark.createDataFrame([(f"u{i:02d}", f) for i, f in enumerate(folds)], "unit string, fold int")


def plain_ridge(x, y, t, k, alpha, width):
    m, s = x.mean(0), x.std(0)
    z, v = (x - m) / s, (t - m) / s
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    a, b = z @ axes[:k].T, v @ axes[:k].T
    if not width:
        return y.mean(0) + b @ np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ (y - y.mean(0)))
    d = ((a[:, None] - a[None]) ** 2).sum(-1)
    w = width * np.median(d[~np.eye(len(d), dtype=bool)])
    kernel, cross = np.exp(-d / w), np.exp(-((b[:, None] - a[None]) ** 2).sum(-1) / w)
    return y.mean(0) + cross @ np.linalg.solve(kernel + alpha * np.eye(len(kernel)), y - y.mean(0))


def test_nested_choices_equal_brute_force_and_see_no_outer_row(spark):
    x, y, folds, units, fold_df = tuning_data(spark)
    alphas, dims, widths = [0.1, 10.0], [2, 5], [0.5, 2.0]
    errors = tuning.nested_errors(units, fold_df, alphas, dims, widths)
    got = {(r.outer, r.k, r.alpha, r.width): r.error for r in errors.collect()}
    want = {}
    for outer in range(4):
        for k in dims:
            for a in alphas:
                for w in [0.0, *widths]:
                    e = 0.0
                    for inner in set(range(4)) - {outer}:
                        tr, te = (folds != outer) & (folds != inner), folds == inner
                        e += ((plain_ridge(x[tr], y[tr], x[te], k, a, w) - y[te]) ** 2).sum()
                    want[outer, k, a, w] = e
    assert got.keys() == want.keys() and all(np.isclose(got[c], want[c]) for c in want)
    picks = {r.outer: (r.k, r.alpha, r.width) for r in tuning.chosen(errors).collect()}
    assert picks == {o: min(((round(e, 9), k, -a, w), (k, a, w)) for (p, k, a, w), e in want.items() if p == o)[1] for o in range(4)}
    out = tuning.nested_predictions(units, fold_df, tuning.chosen(errors)).toPandas()
    for o in range(4):
        own = out[out.outer == o].sort_values(["unit", "output"])
        assert np.allclose(own.prediction, plain_ridge(x[folds != o], y[folds != o], x[folds == o], *picks[o]).ravel())
    bad = units.join(fold_df, "unit").withColumn("y", F.when(F.col("fold") == 2, F.transform("y", lambda v: v + 1000)).otherwise(F.col("y"))).drop("fold")
    after = {(r.outer, r.k, r.alpha, r.width): r.error for r in tuning.nested_errors(bad, fold_df, alphas, dims, widths).filter("outer = 2").collect()}
    assert all(np.isclose(after[c], got[c], rtol=1e-12) for c in after)


def test_refit_nulls_equal_plain_refits(spark):
    x, y, folds, units, fold_df = tuning_data(spark)
    out = tuning.refit_nulls(units, fold_df, 2.0, 3, seed=7).toPandas().sort_values(["unit", "output"])
    for o in range(4):
        tr, te = folds != o, folds == o
        m, s = x[tr].mean(0), x[tr].std(0)
        z, t, rest = (x[tr] - m) / s, (x[te] - m) / s, y[tr] - y[tr].mean(0)
        for draw in range(4):
            rnd = np.random.default_rng([7, draw, o])
            perms = dict(zip(("baseline", "response"), (rnd.permutation(tr.sum()), rnd.permutation(tr.sum()))))
            for family, p in perms.items():
                p = np.arange(tr.sum()) if draw == 0 else p
                a, r = (z[p], rest) if family == "baseline" else (z, rest[p])
                want = y[tr].mean(0) + t @ a.T @ np.linalg.solve(a @ a.T + 2.0 * np.eye(len(a)), r)
                got = out[(out.family == family) & (out.draw == draw) & (out.outer == o)]
                assert np.allclose(got.prediction, want.ravel())
    null = tuning.gain_null(tuning.refit_nulls(units, fold_df, 2.0, 19)).toPandas()
    assert set(null.family) == {"baseline", "response"} and (null.observed > null["mean"]).all() and (null.p <= 0.1).all()


# --- profiled interactions ---------------------------------------------------------------------------


def planted(contexts=8, items=9, features=6, rank=2):
    u, v, w = RND.normal(size=(contexts, rank)), RND.normal(size=(items, rank)), RND.normal(size=(rank, features))
    y = (u[:, None] * v[None]) @ w + RND.normal(size=(contexts, 1, features)) + RND.normal(size=(1, items, features))
    return y


def test_profiled_gradient_and_starts():
    y = planted()
    i, j = (a.ravel() for a in np.indices(y.shape[:2]))
    keep = (i * 3 + j) % 5 != 0
    p = profiled.Profile(i[keep], j[keep], y.reshape(-1, y.shape[2])[keep], y.shape[:2], 2, 1e-6)
    theta = RND.normal(size=sum(y.shape[:2]) * 2)
    _, g = p.value(theta)
    for k in range(0, len(theta), 5):
        e = np.zeros(len(theta))
        e[k] = 1e-6
        assert np.isclose((p.value(theta + e)[0] - p.value(theta - e)[0]) / 2e-6, g[k], atol=1e-6)
    best, ends = profiled.fit_profile(p, 3, 1)
    assert all(e[1] <= 1e-6 for e in ends) and max(e[0] for e in ends) - min(e[0] for e in ends) < 1e-5
    additive, whole = p.predict(best, i[~keep], j[~keep])
    truth = y.reshape(-1, y.shape[2])[~keep]
    assert ((whole - truth) ** 2).sum() < 0.01 * ((additive - truth) ** 2).sum()


def test_profiled_completion_never_reads_hidden_cells(spark):
    y = planted()
    cells = [(0, f"c{a}", f"p{b}", f"f{k}", float(y[a, b, k])) for a, b, k in np.ndindex(*y.shape)]
    df = spark.createDataFrame(cells, "replicate int, context string, intervention string, feature string, value double")
    folds = spark.createDataFrame([(f"c{a}", f"p{b}", (a + 2 * b) % 4) for a in range(8) for b in range(9)], "context string, intervention string, fold int")
    one = profiled.profiled_completion(df, folds, 2, 1e-6).filter("fold = 1").orderBy("context", "intervention", "feature").toPandas()
    spoilt = df.join(folds, ["context", "intervention"]).withColumn("value", F.when(F.col("fold") == 1, F.lit(1e6)).otherwise(F.col("value"))).drop("fold")
    two = profiled.profiled_completion(spoilt, folds, 2, 1e-6).filter("fold = 1").orderBy("context", "intervention", "feature").toPandas()
    assert np.allclose(one.prediction, two.prediction) and one.converged.all() and (two.value == 1e6).all()
    assert ((one.value - one.prediction) ** 2).sum() < 0.05 * ((one.value - one.additive) ** 2).sum()


# --- representations ------------------------------------------------------------------------------------


def test_families(spark):
    x = RND.normal(size=(12, 6))
    q = np.linalg.qr(RND.normal(size=(6, 2)))[0]
    df = spark.createDataFrame([(f"u{i:02d}", f"f{j}", float(x[i, j])) for i in range(12) for j in range(6)], "unit string, feature string, value double")
    basis = spark.createDataFrame([(k, f"f{j}", float(q[j, k])) for k in range(2) for j in range(6)], "axis int, feature string, weight double")
    train = spark.createDataFrame([(f"u{i:02d}",) for i in range(8)], "unit string")
    rep = lambda family, dims=0: np.array([r.x for r in families.representation(df, ["unit"], train, families.orthonormal(basis), family, dims).orderBy("unit").collect()])
    rest = x - x @ q @ q.T
    assert np.allclose(rep("full"), x) and np.allclose(rep("span"), x @ q) and np.allclose(rep("coarse_plus_residual"), x @ q)

    def axes(m, k):
        _, _, vt = np.linalg.svd(m[:8] - m[:8].mean(0), full_matrices=False)
        vt = vt[:k] * np.where(vt[np.arange(k), np.abs(vt[:k]).argmax(1)] < 0, -1, 1)[:, None]
        return (m - m[:8].mean(0)) @ vt.T

    assert np.allclose(rep("pca", 3), axes(x, 3), atol=1e-6) and np.allclose(rep("residual_only", 2), axes(rest, 2), atol=1e-6)
    assert np.allclose(rep("coarse_plus_residual", 2), np.hstack([x @ q, axes(rest, 2)]), atol=1e-6)
    with pytest.raises(ValueError):
        families.orthonormal(basis.withColumn("weight", F.col("weight") * 2))
    with pytest.raises(ValueError):
        rep("other")
    left = families.shared_axis_removal(df, ["unit"], train, [0, 2]).groupBy("rank").agg(F.sum(F.col("residual") ** 2).alias("e")).toPandas().set_index("rank").e
    c = x - x[:8].mean(0)
    vt = np.linalg.svd(c[:8] - c[:8].mean(0), full_matrices=False)[2][:2]
    assert np.isclose(left[0], (c**2).sum()) and np.isclose(left[2], ((c - c @ vt.T @ vt) ** 2).sum())


def test_oracle_residual(spark):
    x = RND.normal(size=(5, 20))
    x[4] = 0.3 * x[0] + 0.7 * x[1]
    g = spark.createDataFrame([(f"c{a}", f"c{b}", float(x[a] @ x[b])) for a in range(5) for b in range(5)], "ctx_a string, ctx_b string, dot double")
    got = {r.context: r for r in families.oracle_residual(g).collect()}
    for t in range(5):
        o = [k for k in range(5) if k != t]
        m = x[o].mean(0)
        a, b = (x[o] - m).T, x[t] - m
        left = b - a @ np.linalg.lstsq(a, b, rcond=1e-9)[0]
        assert np.isclose(got[f"c{t}"].energy, b @ b) and np.isclose(got[f"c{t}"].residual, left @ left, atol=1e-8)
    assert got["c4"].share < 1e-9 and got["c2"].references == 4


# --- boosting ---------------------------------------------------------------------------------------------


def plain_boost(bins, y, trees, depth, rate, l2, least):
    f, out = np.full(len(y), y.mean()), []
    for _ in range(trees):
        g, node, cuts = y - f, np.ones(len(y), int), {}
        for level in range(depth):
            new = node.copy()
            for n in sorted(set(node[node >= 1 << level])):
                m, best = node == n, None
                s, c = g[m].sum(), m.sum()
                for name in sorted(bins):
                    for b in range(32):
                        left = m & (bins[name] <= b)
                        nl = left.sum()
                        if nl >= least and c - nl >= least:
                            sl = g[left].sum()
                            gain = sl**2 / (nl + l2) + (s - sl) ** 2 / (c - nl + l2) - s**2 / (c + l2)
                            key = (round(gain, 9), -b, name)
                            if gain > 1e-12 and (best is None or key > best[0]):
                                best = (key, name, b)
                if best:
                    cuts[n] = best[1:]
                    new[m] = np.where(bins[best[1]][m] <= best[2], 2 * n, 2 * n + 1)
            node = new
        leaf = {n: rate * g[node == n].sum() / ((node == n).sum() + l2) for n in set(node)}
        f = f + np.array([leaf[n] for n in node])
        out.append(cuts)
    return out, f


def test_boosting_equals_numpy_on_equal_bins(spark):
    n = 400
    a, b = RND.integers(0, 60, n) / 7.0, RND.normal(size=n)
    y = np.where(a > 4, 2.0, -1.0) + np.abs(b) + 0.1 * RND.normal(size=n)
    df = spark.createDataFrame([(float(p), float(q) if k % 50 else None, float(z), k) for k, (p, q, z) in enumerate(zip(a, b, y))], "a double, b double, y double, k int").repartition(6)
    model = boost.fit(df, ["a", "b"], "y", 12, depth=2, rate=0.3, l2=1.0, least=5, bins=16)
    held = boost.predict(boost.binned(df, model[2]).withColumn("own", F.col("bins")).drop("bins"), model).orderBy("k").toPandas()
    bins = {c: np.array([r[c] for r in held.own]) for c in ("a", "b")}
    for c, v in (("a", a), ("b", np.array([q if k % 50 else np.nan for k, q in enumerate(b)]))):
        seen = v[~np.isnan(v)]
        e = sorted(set(np.quantile(seen, [k / 16 for k in range(1, 16)])))
        assert np.allclose(model[2][c], e)
        assert (bins[c] == [0 if np.isnan(x) else sum(q < x for q in model[2][c]) for x in v]).all()
    trees, f = plain_boost(bins, y, 12, 2, 0.3, 1.0, 5)
    assert [t.cuts for t in model[1]] == trees and np.allclose(held.prediction, f)
    assert ((held.prediction - y) ** 2).mean() < 0.5 * y.var()


# --- shrinkage --------------------------------------------------------------------------------------------


def test_shrunk_covariance_and_proximities(spark):
    x = RND.normal(size=(15, 4)) @ RND.normal(size=(4, 4))
    df = spark.createDataFrame([("g", f"r{i:02d}", f"n{j}", float(x[i, j])) for i in range(15) for j in range(4)], "`group` string, row string, name string, value double")
    c = x - x.mean(0)
    s = c.T @ c / 15
    mu = np.trace(s) / 4
    d2 = ((s - mu * np.eye(4)) ** 2).sum()
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 15**2
    w = min(b2, d2) / d2
    want = (1 - w) * s + w * mu * np.eye(4)
    got = shrinkage.shrunk(df)
    m = got.toPandas()
    assert np.allclose(m.pivot(index="a", columns="b", values="cov"), want) and np.allclose(m.shrinkage, w)
    near = shrinkage.proximities(df.withColumnRenamed("row", "point"), shrinkage.precision(got)).toPandas().set_index(["source", "target"])
    inv = np.linalg.inv(want)
    for i, j in ((0, 1), (7, 3)):
        r, d = near.loc[f"r{i:02d}", f"r{j:02d}"], x[i] - x[j]
        assert np.isclose(r.mahalanobis, -np.sqrt(d @ inv @ d)) and np.isclose(r.euclidean, -np.linalg.norm(d)) and np.isclose(r.pearson, np.corrcoef(x[i], x[j])[0, 1])
        assert np.isclose(r.cosine, x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]))
    one = shrinkage.shrunk(df.filter("row = 'r00'")).toPandas()
    assert (one["cov"] == 0).all() and (one.shrinkage == 0).all()


def test_transfer_utility_of_a_constant(spark):
    rows = [(c, "p", i, v) for c, vs in {"a": [1.0, 2.0, 4.0], "b": [5.0, 5.0, 5.0]}.items() for i, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "context string, program string, intervention int, score double")
    base = s.select("program", F.col("context").alias("target"), "intervention", F.lit(2.0).alias("score"))
    u = {(r.source, r.target): r for r in shrinkage.transfer_utility(s, base).collect()}
    assert u["b", "a"].pearson == 0 and np.isclose(u["b", "a"].mse, (16 + 9 + 1) / 3) and np.isclose(u["b", "a"].mse_utility, (1 + 0 + 4) / 3 - 26 / 3)


# --- digests and replay -------------------------------------------------------------------------------------


def test_digests_tell_training_from_held_out(spark):
    rows = [(f"u{i}", i / 3, None if i == 4 else "x") for i in range(9)]
    df = spark.createDataFrame(rows, "unit string, v double, t string")
    folds = spark.createDataFrame([(f"u{i}", i % 3) for i in range(9)], "unit string, fold int")
    take = lambda d: leakage.training_digests(d, folds, "unit", {"all": ["unit", "v", "t"], "v": ["v"]})
    base = take(df)
    moved = leakage.compare(base, take(df.repartition(7).orderBy(F.desc("v"))), ["outer", "object"]).collect()
    assert len(moved) == 6 and all(r.same for r in moved)
    changed = take(df.withColumn("v", F.when(F.col("unit") == "u4", 99.0).otherwise(F.col("v"))))
    assert {(r.outer, r.object): r.same for r in leakage.compare(base, changed, ["outer", "object"]).collect()} == {(o, n): o == 1 for o in range(3) for n in ("all", "v")}
    twice = take(df.unionByName(df.filter("unit = 'u0'")))
    assert not any(r.same for r in leakage.compare(base, twice, ["outer", "object"]).filter("outer <> 0").collect())
    parts = [leakage.digest(df.filter(c), [], ["v"]).first() for c in ("v < 1", "v >= 1", "true")]
    total = [sum(int(p.digest.split("-")[k]) for p in parts[:2]) for k in (0, 1)]
    assert "-".join(map(str, total)) == parts[2].digest and parts[0].rows + parts[1].rows == 9


def test_replay_finds_each_fault(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    check = lambda b, tol=1e-6: {r.check: r.passed for r in leakage.replay(a, b, ["k"], "v", tol).collect()}
    assert all(check(a).values())
    assert not check(spark.createDataFrame([(1, 1.0), (2, 2.1), (3, None)], a.schema))["values agree"]
    assert not check(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], a.schema))["values agree"]
    assert not check(a.filter("k < 3"))["keys on both sides"]
    assert not check(a.unionByName(a.filter("k = 1")))["again keys are unique"]


# --- ranks ----------------------------------------------------------------------------------------------------


def test_ranks_and_quantiles(spark):
    v = [float(x) for x in RND.integers(0, 9, 60)] + [None, None]
    df = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(v)], "i int, v double, g int").repartition(7)
    got = {r.i: r for r in ranks.average_ranks(df, "v").collect()}
    seen = pd.Series(v[:60]).rank().tolist()
    assert [got[i].r_v for i in range(60)] == seen and got[60].r_v is None and len(got) == 62
    places = {r.i: r.place for r in ranks.numbered(df, F.col("v").desc_nulls_last(), F.col("i").asc()).collect()}
    order = sorted(range(62), key=lambda i: (v[i] is None, -(v[i] or 0), i))
    assert [places[i] for i in order] == list(range(1, 63))
    q = {(r.g, r.point): r.q for r in ranks.quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    assert all(np.isclose(q[g, p], np.quantile([x for i, x in enumerate(v) if x is not None and i % 2 == g], p)) for g in (0, 1) for p in (0.0, 0.1, 0.5, 0.77, 1.0))
    run = {r.i: (r.s, r.m) for r in ranks.running(df.filter("v is not null"), [F.col("i").asc()], {"s": F.col("v")}, {"m": F.col("v")}).collect()}
    assert run[0] == (0.0, None) and all(run[k] == (sum(v[:k]), max(v[:k])) for k in range(1, 60))
    assert ranks.numbered(df.filter("i < 0"), F.col("i").asc()).count() == 0


@pytest.mark.parametrize("name", ["sign_flip_max_t", "random_comparator", "null_summary", "permutation_mean", "fingerprint_permutation"])
def test_counts_do_not_hang_on_partitioning(spark, name):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(str, registry.queries()[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert out[0] == out[1]


def test_store_follows_the_tables(spark, tmp_path):
    path = str(tmp_path)
    for t in facts.TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    one = facts.facts(spark, path).filter("feature = 'quantity'").agg(F.sum("value")).first()[0]
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_quantity", F.col("l_quantity") + 1000).write.mode("overwrite").parquet(f"{path}/lineitem.parquet")
    assert facts.facts(spark, path).filter("feature = 'quantity'").agg(F.sum("value")).first()[0] > one + 1000


# --- chunked sources --------------------------------------------------------------------------------------------


def test_row_groups_are_chosen_at_planning(spark, tmp_path):
    path = f"{tmp_path}/by-key"
    df = spark.range(40_000).select((F.col("id") % 8).cast("int").alias("k"), F.concat(F.lit("c"), (F.col("id") % 8).cast("string")).alias("t"), F.col("id"), F.rand(1).alias("v"))
    for k in range(8):
        df.filter(F.col("k") == k).coalesce(1).write.mode("append").parquet(path)
    read = rowgroups.row_groups(spark, path, ["k", "t", "v"])
    where = lambda *w: rowgroups.row_groups(spark, path, ["k", "t", "v"], list(w))
    got = where(("k", "in", [2, 5]))
    assert got.rdd.getNumPartitions() == 2 and got.count() == 10_000
    assert sorted(r.k for r in got.select("k").distinct().collect()) == [2, 5]
    assert np.isclose(read.agg(F.sum("v")).first()[0], df.agg(F.sum("v")).first()[0])
    assert where(("t", "=", "c3"), ("v", ">", 0.5)).count() == df.filter("t = 'c3' and v > 0.5").count() and where(("k", ">", 99)).count() == 0
    assert read.filter("k = 1").count() == 5000 and read.count() == 40_000  # uses of one DataFrame share nothing

    def plan(where, **options):
        source = rowgroups.RowGroups({"path": path, "columns": "k,v", "where": json.dumps(where), **{k: str(v) for k, v in options.items()}})
        return source.reader(source.schema()).partitions()

    every, some = plan([]), plan([("k", "=", 3)])
    assert len(every) == 8 and len(some) == 1 and sum(g.bytes for g in some) < sum(g.bytes for g in every) / 6
    assert len(plan([("k", "in", [1, 2])], keys="k", expected=2)) == 2
    assert len(plan([("k", ">=", 6), ("k", "<", 7)])) == 1
    with pytest.raises(ValueError):
        plan([], keys="k", expected=7)
    with pytest.raises(ValueError):
        plan([], most_bytes=10)
    index = f"{tmp_path}/index"
    rowgroups.footer_index(spark, path, ["k", "v"]).write.parquet(index)
    assert [(g.file, g.row_group, g.bytes) for g in plan([("k", "=", 3)], index=index)] == [(g.file, g.row_group, g.bytes) for g in some]


def test_zarr_round_trip_and_pruning(spark, tmp_path):
    cube = RND.normal(size=(7, 5, 4))
    cube[6, 4, 3] = np.nan
    cells = spark.createDataFrame([(a, b, c, float(cube[a, b, c])) for a, b, c in np.ndindex(*cube.shape) if not np.isnan(cube[a, b, c])], "i0 long, i1 long, i2 long, value double")
    path = f"{tmp_path}/cube"
    arrays.save_zarr(cells, path, cube.shape, (3, 2, 4))
    arrays.save_zarr(cells, path, cube.shape, (3, 2, 4))  # once more leaves the same
    df = arrays.chunked_array(spark, path)
    got = np.full(cube.shape, 9.0)
    for r in df.collect():
        got[r.i0, r.i1, r.i2] = r.value
    assert np.array_equal(got, cube, equal_nan=True) and df.rdd.getNumPartitions() == 9
    for name in os.listdir(path):
        if name[0].isdigit() and name != "1.0.0":
            with open(f"{path}/{name}", "wb") as f:
                f.write(b"broken")
    part = arrays.chunked_array(spark, path, select={0: [4], 1: [0, 1], 2: range(2, 4)})
    assert part.rdd.getNumPartitions() == 1 and sorted((r.i1, r.i2, r.value) for r in part.collect()) == [(b, c, cube[4, b, c]) for b in (0, 1) for c in (2, 3)]
    os.remove(f"{path}/0.0.0")  # an absent chunk holds the fill value
    assert arrays.chunked_array(spark, path, select={0: [0], 1: [0]}).filter(F.isnan("value")).count() == 4
    assert arrays.chunked_array(spark, path, select={0: [50]}).count() == 0
    with pytest.raises(Exception):
        arrays.save_zarr(cells.unionByName(cells), f"{tmp_path}/twice", cube.shape, (3, 2, 4))
    with pytest.raises(Exception):
        arrays.save_zarr(cells, f"{tmp_path}/small", (2, 2, 2), (2, 2, 2))


def test_zarr_version_3_and_codecs(spark, tmp_path):
    import zstandard

    m = np.arange(12, dtype=">i4").reshape(3, 4)
    os.makedirs(f"{tmp_path}/z/c/0")
    meta = {"zarr_format": 3, "shape": [3, 4], "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [3, 2]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "zstd"}]}
    with open(f"{tmp_path}/z/zarr.json", "w") as f:
        json.dump(meta, f)
    for k in (0, 1):
        with open(f"{tmp_path}/z/c/0/{k}", "wb") as f:
            f.write(zstandard.ZstdCompressor().compress(np.ascontiguousarray(m[:, 2 * k : 2 * k + 2]).tobytes()))
    got = {(r.i0, r.i1): r.value for r in arrays.chunked_array(spark, f"{tmp_path}/z").collect()}
    assert got == {(a, b): float(m[a, b]) for a in range(3) for b in range(4)}
    os.makedirs(f"{tmp_path}/b")
    with open(f"{tmp_path}/b/.zarray", "w") as f:
        json.dump({"zarr_format": 2, "shape": [1], "chunks": [1], "dtype": "<f8", "compressor": {"id": "blosc"}, "fill_value": 0, "order": "C", "filters": None}, f)
    with pytest.raises(Exception):
        arrays.chunked_array(spark, f"{tmp_path}/b").collect()


def test_npy_and_npz(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "ROW_BYTES", 64)
    c, f, one = RND.normal(size=(9, 3)), np.asfortranarray(RND.normal(size=(4, 5)).astype("f4")), np.arange(6)
    np.save(f"{tmp_path}/c.npy", c)
    np.save(f"{tmp_path}/f.npy", f)
    np.savez(f"{tmp_path}/stored.npz", c=c, one=one)
    np.savez_compressed(f"{tmp_path}/deflated.npz", c=c, one=one)
    table = lambda df: {tuple(r[:-1]): r.value for r in df.collect()}
    want = lambda m: {i: float(m[i]) for i in np.ndindex(*m.shape)}
    assert table(arrays.chunked_array(spark, f"{tmp_path}/c.npy")) == want(c) and table(arrays.chunked_array(spark, f"{tmp_path}/f.npy")) == want(f)
    for name in ("stored", "deflated"):
        assert table(arrays.chunked_array(spark, f"{tmp_path}/{name}.npz", "c")) == want(c) and table(arrays.chunked_array(spark, f"{tmp_path}/{name}.npz", "one")) == want(one)
    assert arrays.layout(f"{tmp_path}/c.npy").chunks == (2, 3) and arrays.layout(f"{tmp_path}/stored.npz", "c").offset > 0
    reader = arrays.ArrayReader(f"{tmp_path}/c.npy", arrays.layout(f"{tmp_path}/c.npy"), {0: [5]})
    assert [p.at for p in reader.partitions()] == [(2, 0)]
    assert zipfile.is_zipfile(f"{tmp_path}/stored.npz")
