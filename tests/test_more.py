"""Operators of nulls, sealed statistics, freezing, texts and file gates that SQL doesn't check."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.functions import text as T
from gridstone.operators import freeze, interaction, nulls, sealed
from gridstone.plans import registry
from gridstone.sources import files

SF = "/root/testdata/sf0.001"


def dense(df, row, column, value):
    return df.toPandas().pivot(index=row, columns=column, values=value).sort_index()


def test_kernel_weights_against_numpy(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(6, 4))
    g = x @ x.T
    names = list("abcdef")
    df = spark.createDataFrame([(a, b, float(g[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "ctx_a string, ctx_b string, dot double")
    got = dense(sealed.kernel_weights(df, 0.3), "context", "source", "weight")
    for i, c in enumerate(names):
        t = [j for j in range(6) if j != i]
        s = np.trace(g[np.ix_(t, t)]) / 5
        w = np.linalg.solve(g[np.ix_(t, t)] / s + 0.3 * np.eye(5), g[t, i] / s)
        assert np.allclose(got.loc[c, [names[j] for j in t]], w + (1 - w.sum()) / 5)


def test_nested_penalty_scores_held_out_folds(spark):
    from gridstone.operators.models import affine_weights

    rnd = np.random.default_rng(1)
    names, grams, rows = list("abcd"), {}, []
    for fold in range(3):
        x = rnd.normal(size=(4, 5))
        grams[fold] = x @ x.T
    for fold in range(3):
        for part, g in (("test", grams[fold]), ("fit", sum(grams[k] for k in grams if k != fold))):
            rows += [(fold, part, a, b, float(g[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    df = spark.createDataFrame(rows, "hidden int, part string, ctx_a string, ctx_b string, dot double")
    ridges = [0.01, 1.0, 100.0]
    got = sealed.nested_penalty(df, ridges).toPandas().set_index(["context", "ridge"])
    for i, c in enumerate(names):
        t = [j for j in range(4) if j != i]
        errors = []
        for ridge in ridges:
            e = 0.0
            for fold in range(3):
                fit = sum(grams[k] for k in grams if k != fold)
                w = affine_weights(fit[np.ix_(t, t)], fit[t, i], ridge)
                v = np.zeros(4)
                v[i], v[t] = -1, w
                e += v @ grams[fold] @ v
            errors.append(e)
            assert np.isclose(got.loc[(c, ridge), "error"], e)
        assert got.loc[(c, ridges[int(np.argmin(errors))]), "picked"]


def test_span_basis_spans(spark):
    rnd = np.random.default_rng(2)
    m = rnd.normal(size=(3, 5))
    m[2] = m[0] + m[1]
    df = spark.createDataFrame([(str(i), f"f{j}", float(m[i, j])) for i in range(3) for j in range(5)], "axis string, feature string, weight double")
    b = dense(sealed.span_basis(df), "axis", "feature", "weight").to_numpy()
    assert b.shape == (2, 5) and np.allclose(b @ b.T, np.eye(2)) and np.allclose(m @ b.T @ b, m)


def test_sealed_never_sees_hidden_rows(spark):
    df = spark.createDataFrame([(0, c, i, "f", float(len(c) * 7 + ord(i))) for c in ("aa", "b", "cccc") for i in "xyz"], "replicate int, context string, intervention string, feature string, value double")
    hidden = df.filter("context = 'b' and intervention = 'x'").select("context", "intervention")
    loud = df.withColumn("value", F.when((F.col("context") == "b") & (F.col("intervention") == "x"), 1e9).otherwise(F.col("value")))
    mask = (F.col("context") == "b") & (F.col("intervention") == "x")
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(sealed.sealed(df, hidden)) == rows(sealed.sealed(loud, hidden))
    assert rows(sealed.additive_completion(df, mask).select("context", "intervention", "filled")) == rows(sealed.additive_completion(loud, mask).select("context", "intervention", "filled"))
    assert rows(sealed.masked_baseline(df, mask).select("baseline")) == rows(sealed.masked_baseline(loud, mask).select("baseline"))
    assert sealed.refuse(sealed.sealed(df, hidden), hidden).count() == 8
    with pytest.raises(Exception, match="hidden row"):
        sealed.refuse(df, hidden).collect()


def test_permutations_are_permutations(spark):
    u = spark.createDataFrame([(i, i % 2) for i in range(9)], "u int, b int")
    p = nulls.permutation(u, "u", 7, "s", ["b"]).collect()
    for draw in range(7):
        own = [r for r in p if r.draw == draw]
        assert sorted(r.u for r in own) == sorted(r.other for r in own) == list(range(9)) and all(r.u % 2 == r.other % 2 == r.b for r in own)
    s = nulls.shifts(u, "u").collect()
    assert len(s) == 72 and all(r.u != r.other for r in s)


def test_text_gates(spark):
    df = spark.createDataFrame([("MP-ACGT-1", "Pt12-a", "1;2.5;x")], "c string, s string, l string")
    got = df.select(T.cell_id(F.col("c")), T.patient(F.col("s")), T.floats(F.col("l"))).first()
    assert tuple(got) == ("1_ACGT", "Pt12", [1.0, 2.5, None])
    for bad in (T.cell_id(F.lit("oops")), T.patient(F.lit("x1"))):
        with pytest.raises(Exception, match="no cell id|no patient"):
            df.select(bad).collect()
    with pytest.raises(KeyError):
        T.column_of(df, "nothing")
    assert df.select(T.roll(F.array(F.lit(1), F.lit(2), F.lit(3)), -1)).first()[0] == [2, 3, 1]


def test_dense_rows_and_audit(spark):
    df = spark.createDataFrame([("a", f"g{k}", float(k) if k != 3 else float("nan")) for k in range(20)] + [("b", "g1", 1.0)], "r string, g string, v double")
    got = freeze.dense_rows(df, "r", "g", "v", 0.95).collect()
    assert len(got) == 20 and {r.r for r in got} == {"a"} and sum(r.v for r in got) == sum(range(20)) - 3


def test_file_gates(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/nation.parquet")
    for k in range(3):
        src.filter(F.col("n_regionkey") == k).coalesce(1).write.parquet(f"{tmp_path}/t/{k}")
    paths = [os.path.join(r, f) for r, _, fs in os.walk(f"{tmp_path}/t") for f in fs if f.endswith(".parquet")]
    groups = files.constant_row_groups(spark, paths, ["n_regionkey", "n_name"])
    got = groups.collect()
    assert sorted(r.n_regionkey for r in got) == ["0", "1", "2"] and sum(r.rows for r in got) == src.filter("n_regionkey < 3").count() and not any(r.constant and r.n_name is None for r in got)
    wanted = spark.createDataFrame([("1",), ("2",)], "n_regionkey string")
    assert files.selected_groups(groups, wanted, ["n_regionkey"], 2, 10**6).count() == 2
    for expected, most in ((3, 10**6), (2, 1)):
        with pytest.raises(ValueError):
            files.selected_groups(groups, wanted, ["n_regionkey"], expected, most)
    (tmp_path / "m").mkdir()
    for k in range(2):
        (tmp_path / "m" / f"{k}.csv").write_text(f"id,x\n{k},1\n")
    assert files.manifests(spark, f"{tmp_path}/m/*.csv", "id").count() == 2
    (tmp_path / "m" / "9.csv").write_text("id,x\n1,1\n")
    with pytest.raises(ValueError, match="unique"):
        files.manifests(spark, f"{tmp_path}/m/*.csv", "id")
    files.write_json(f"{tmp_path}/p.json", {"seed": 1})
    assert files.protocol(f"{tmp_path}/p.json", ["seed"]) == {"seed": 1} and not os.path.exists(f"{tmp_path}/p.json.part")
    with pytest.raises(KeyError):
        files.protocol(f"{tmp_path}/p.json", ["draws"])
    for _ in range(2):
        files.append_rows(src, f"{tmp_path}/rows")
    assert spark.read.option("header", True).csv(f"{tmp_path}/rows").count() == 2 * src.count()
    files.save_draws(spark.range(50).withColumn("draw", F.col("id") % 5), f"{tmp_path}/draws")
    assert spark.read.parquet(f"{tmp_path}/draws").count() == 50
    files.output_manifest(spark, f"{tmp_path}/draws", "*.parquet", f"{tmp_path}/out.json")
    listed = json.load(open(f"{tmp_path}/out.json"))["files"]
    assert listed and all(os.path.getsize(f"{tmp_path}/draws/{f['name']}") == f["bytes"] and len(f["sha256"]) == 64 for f in listed)


def test_nested_folds_add_up(spark):
    g = registry.gamma(spark, SF, "r_name").select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    from gridstone.operators import design

    parts = sealed.by_fold(g, design.stride_folds(g, "intervention", "np"))
    whole = {(r.ctx_a, r.ctx_b): r.dot for r in interaction.context_gram(interaction.gram(g)).collect()}
    for r in parts.groupBy("hidden", "ctx_a", "ctx_b").agg(F.sum("dot").alias("dot")).collect():
        assert abs(r.dot - whole[r.ctx_a, r.ctx_b]) < 1e-6


def test_fisher_against_counts(spark):
    import math

    from gridstone.operators import inference

    def exact(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        p = {k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col) for k in range(max(0, row + col - n), min(row, col) + 1)}
        return sum(x for k, x in p.items() if k >= a), sum(x for x in p.values() if x <= p[a] * (1 + 1e-7))

    tables = [(3, 1, 1, 3), (0, 5, 7, 2), (10, 0, 0, 10), (120, 380, 260, 900), (1, 0, 0, 0), (0, 0, 4, 4)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    for r in df.select("*", inference.fisher_greater("a", "b", "c", "d").alias("p"), inference.fisher_two_sided("a", "b", "c", "d").alias("q")).collect():
        one, two = exact(r.a, r.b, r.c, r.d)
        assert abs(r.p - min(1, one)) < 1e-7 and abs(r.q - min(1, two)) < 1e-7


def test_landmark_ridge_is_kernel_ridge_where_all_rows_are_landmarks(spark):
    from gridstone.operators import models

    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=3).tolist(), float(rnd.normal()), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, fold int")
    got = {r.id: r.prediction for r in models.landmark_ridge(df.drop("fold"), df.select("id", "fold"), 0.1, 1000).collect()}
    x, y, fold = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert len(got) == 60
    for k in range(3):
        z, t = x[fold != k], fold == k
        d = lambda a, b: ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
        dz = d(z, z)
        width = np.median(dz[dz > 0])
        f = lambda a: np.c_[np.exp(-d(a, z) / width), np.ones(len(a))]
        p = 0.1 * np.eye(len(z) + 1)
        p[-1, -1] = 0
        w = np.linalg.solve(f(z).T @ f(z) + p, f(z).T @ y[fold != k])
        assert np.allclose([got[i] for i in np.flatnonzero(t)], f(x[t]) @ w, atol=1e-6)


def test_cells_are_written_once_and_again_where_lost(spark):
    import shutil

    from gridstone.sources import facts

    first = facts.stored_cells(spark, SF, "r_name", "p_brand").count()
    key = (spark.sparkContext.applicationId, "cells-r_name-p_brand", facts.state(spark, [f"{SF}/{t}.parquet" for t in facts.TABLES]))
    path = facts._stored[key][0]
    assert facts.facts(spark, SF, "r_name").count() == 4 * first and facts._stored[key][0] == path
    shutil.rmtree(path.removeprefix("file://"))
    assert facts.stored_cells(spark, SF, "r_name", "p_brand").count() == first
