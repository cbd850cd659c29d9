"""Derangements, weighted ranks, episode choices, programs and classifier grids against plain NumPy."""

import hashlib
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridstone.operators import classify, crossgram, decompose, families, freeze, leakage, models, nulls, programs, ranks, sealed
from gridstone.operators.models import affine_weights
from gridstone.sources import files, sheets

RND = np.random.default_rng(11)


def test_derangements_leave_nothing_in_place(spark):
    for n, shifts in ((2, 1), (3, 2), (5, 44), (8, 6), (1, 0)):
        units = spark.createDataFrame([(f"u{i}",) for i in range(n)], "unit string")
        got = nulls.derangements(units, "unit", 6, "x").toPandas()
        each = [tuple(g.sort_values("unit").other) for _, g in got.groupby("shift")]
        assert len(each) == len(set(each)) == shifts or n == 8 and len(each) == 6
        assert (got.unit != got.other).all() and all(sorted(e) == sorted(f"u{i}" for i in range(n)) for e in each)


def test_weighted_ranks_equal_ranks_of_repeated_rows(spark):
    rows = [(k, float(RND.integers(0, 6)), float(RND.integers(0, 4)), int(RND.integers(1, 4))) for k in (0, 1) for _ in range(25)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k int, x double, y double, w int")
    got = {r.i: r.r for r in ranks.weighted_ranks(df, ["k"], "x", "w", "r").collect()}
    for k in (0, 1):
        long = pd.Series([x for g, x, _, w in rows if g == k for _ in range(w)])
        want = dict(zip(long, long.rank()))
        assert all(np.isclose(got[i], want[x]) for i, (g, x, _, _) in enumerate(rows) if g == k)
        a, b = (np.repeat([r[c] for r in rows if r[0] == k], [r[3] for r in rows if r[0] == k]) for c in (1, 2))
        r = nulls.weighted_correlation(df.filter(F.col("k") == k), ["k"], "w", "x", "y").first()
        assert np.isclose(r.r, np.corrcoef(a, b)[0, 1]) and r.n == len(a)
    flat = df.withColumn("y", F.lit(1.0))
    assert all(r.r is None for r in nulls.weighted_correlation(flat, ["k"], "w", "x", "y").collect())


def fold_grams(n=5, folds=3, size=30):
    x = RND.normal(size=(n, size))
    x[0] = 0.5 * x[1] + 0.4 * x[2] + 0.2 * RND.normal(size=size)
    fold = np.arange(size) % folds
    rows = [(k, part, f"c{a}", f"c{b}", float(x[a][m] @ x[b][m])) for k in range(folds) for part, m in (("test", fold == k), ("fit", fold != k)) for a in range(n) for b in range(n)]
    return x, fold, rows


def test_episode_and_free_choices_equal_brute_force(spark):
    x, fold, rows = fold_grams()
    df = spark.createDataFrame(rows, "hidden int, part string, ctx_a string, ctx_b string, dot double")
    free = {(r.context, r.ridge): r for r in sealed.nested_penalty(df, [0.01, 1.0], "free").collect()}
    choices = {(r.context, r.ridge, r.rank, r.pull): r for r in sealed.episode_choices(df, [0.01, 1.0], [1, 4], [0.0, 0.5]).collect()}
    for t in range(5):
        o = [k for k in range(5) if k != t]
        for ridge in (0.01, 1.0):
            e, errors = 0.0, {}
            for k in range(3):
                a, b = x[:, fold != k], x[:, fold == k]
                g, c = a[o] @ a[o].T, a[o] @ a[t]
                w = np.linalg.solve(g + ridge * np.trace(g) / 4 * np.eye(4), c)
                e += ((b[t] - w @ b[o]) ** 2).sum()
                h = np.eye(4) - 1 / 4
                axes = np.linalg.eigh(h @ g @ h)[1][:, ::-1]
                v = affine_weights(g, c, ridge) - 1 / 4
                for rank in (1, 4):
                    bent = h @ axes[:, :rank] @ axes[:, :rank].T @ v
                    for pull in (0.0, 0.5):
                        u = 1 / 4 + (1 - pull) * bent
                        assert np.isclose(u.sum(), 1)
                        errors[rank, pull] = errors.get((rank, pull), 0.0) + ((b[t] - u @ b[o]) ** 2).sum()
            assert np.isclose(free[f"c{t}", ridge].error, e)
            assert all(np.isclose(choices[f"c{t}", ridge, *k].error, v) for k, v in errors.items())
        assert sum(r.picked for (c, *_), r in choices.items() if c == f"c{t}") == 1
        best = min((r.error for (c, *_), r in choices.items() if c == f"c{t}"))
        assert next(r.error for (c, *_), r in choices.items() if c == f"c{t}" and r.picked) <= best + 1e-9
    twice = df.unionByName(df.limit(1))
    with pytest.raises(Exception):
        sealed.nested_penalty(twice, [1.0]).collect()


def test_programs_recover_what_was_planted(spark):
    h = np.array([[5.0, 4, 0, 0, 0, 1], [0, 0, 6, 2, 0, 0], [0, 1, 0, 0, 3, 4]])
    w = RND.random((120, 3)) ** 2
    x = w @ h
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)], "id int, x array<double>").repartition(5)
    found = programs.fit_programs(df.filter("id < 90"), 3, passes=120, seed=1)
    partner, cos = programs.matched_programs(h, found)
    assert sorted(partner) == [0, 1, 2] and (cos > 0.97).all()
    out = programs.transform(df, found).toPandas().set_index("id").sort_index()
    assert (out.error < 0.02 * (x**2).sum(1).mean()).all() and len(out) == 120 and all((np.array(v) >= 0).all() for v in out.weights)
    spoilt = df.withColumn("x", F.when(F.col("id") >= 90, F.transform("x", lambda v: v * 50)).otherwise(F.col("x")))
    assert np.allclose(programs.fit_programs(spoilt.filter("id < 90"), 3, passes=10), programs.fit_programs(df.filter("id < 90"), 3, passes=10))
    same = programs.stability(df, 3, [1, 2], passes=120).toPandas()
    assert len(same) == 3 and (same.cosine > 0.95).all() and sorted(same.partner) == [0, 1, 2]
    with pytest.raises(ValueError):
        programs.matched_programs(h, h[:2])


def test_grid_finds_the_setting_with_the_least_loss(spark):
    n = 240
    a, b = RND.normal(size=n), RND.normal(size=n)
    y = ((a * b) > 0).astype(int)  # no line parts these classes, trees do
    df = spark.createDataFrame([(float(p), None if k % 40 == 0 else float(q), int(z), k % 3) for k, (p, q, z) in enumerate(zip(a, b, y))], "a double, b double, y int, fold int")
    losses = classify.grid_losses(df, ["a", "b"], "y", "fold")
    out = classify.chosen_settings(losses).toPandas()
    assert len(out) == 6 and losses.agg(F.sum("rows")).first()[0] == 6 * n and out.groupby("family").picked.sum().eq(1).all()
    best = out[out.picked].set_index("family").loss
    assert best["forest"] < 0.55 < 0.66 < best["logistic"] and all(g.loss.min() == g[g.picked].loss.iloc[0] for _, g in out.groupby("family"))


def test_controls(spark):
    shares = spark.createDataFrame([(-1, 0.5), (0, 0.1), (1, 0.5 + 1e-13), (2, 0.3)], "draw int, share double")
    r = families.control_summary(shares).first()
    assert r.observed == 0.5 and np.isclose(r["mean"], 0.3) and r.p == 0.5
    signal = spark.createDataFrame([("a", 2.0, 1.0), ("b", 3.0, 4.0)], "axis string, s double, e double")
    out = {tuple(r.axes): r for r in families.subset_fidelity(signal, spark.createDataFrame([(10.0,)], "s double")).collect()}
    assert len(out) == 3 and out["a", "b"].f == 0.5 and out["a",].g == 0.5 and np.isclose(out["b",].u, -0.1)
    with pytest.raises(ValueError):
        families.subset_fidelity(spark.range(21).selectExpr("string(id) as axis", "1d as s", "1d as e"), signal)


def test_sides_of_donors(spark):
    got = crossgram.sides(spark.createDataFrame([(d,) for d in "wxyz"], "donor string")).toPandas()
    assert len(got[got.kind == "halves"]) == 12 and len(got[got.kind == "rest"]) == 16
    assert all(sorted(g.donor) == list("wxyz") for _, g in got.groupby(["kind", "part"]))


def test_episode_weights_equal_lstsq(spark):
    x = RND.normal(size=(6, 25))
    x[5] = x[4]  # equal sources share their weight
    g = spark.createDataFrame([(f"c{a}", f"c{b}", float(x[a] @ x[b])) for a in range(6) for b in range(6)], "ctx_a string, ctx_b string, dot double")
    sets = {"one": (0, [3]), "some": (1, [0, 2, 3]), "twins": (2, [0, 4, 5])}
    ep = spark.createDataFrame([(k, f"c{t}", f"c{s}") for k, (t, ss) in sets.items() for s in ss], "episode string, target string, source string")
    w = models.episode_weights(g, ep)
    got = {(r.episode, r.source): r.weight for r in w.collect()}
    err = {r.episode: r for r in models.episode_errors(g, ep, w).collect()}
    for k, (t, ss) in sets.items():
        own = np.array([got[k, f"c{s}"] for s in ss])
        base = x[ss[0]]
        rest = (x[ss[1:]] - base).T
        want = x[t] - base - rest @ np.linalg.lstsq(rest, x[t] - base, rcond=None)[0] if len(ss) > 1 else x[t] - base
        assert np.isclose(own.sum(), 1) and np.isclose(err[k].error, want @ want) and np.isclose(err[k].energy, x[t] @ x[t]) and err[k].m == len(ss)
    assert np.isclose(got["twins", "c4"], got["twins", "c5"]) and np.isclose(got["one", "c3"], 1)


def test_timing_gate_runs_a_few_episodes(spark):
    df = spark.range(30).withColumn("e", F.col("id") % 6)
    ran = []
    out = leakage.timing_gate(df, "e", lambda x: (ran.append(x.select("e").distinct().count()), x)[1], 1e6).collect()
    assert len(out) == 4 and ran == [1] * 4 and all(r.passed and np.isclose(r.projected, 6 * max(q.seconds for q in out)) for r in out)
    assert not any(r.passed for r in leakage.timing_gate(df, "e", lambda x: x, 0.0).collect())
    assert leakage.timing_gate(df.filter("id < 0"), "e", lambda x: x, 1.0).count() == 0


def test_module_ladder(spark):
    t = RND.normal(size=(20, 2))
    x = np.hstack([t[:, :1] + 0.05 * RND.normal(size=(20, 3)), t[:, 1:] + 0.05 * RND.normal(size=(20, 2))])
    df = spark.createDataFrame([(f"u{i}", f"n{j}", float(x[i, j])) for i in range(20) for j in range(5)], "u string, name string, value double")
    out = decompose.module_ladder(df, ["u"], [0.2, 3.0]).toPandas()
    low = out[out.cut == 0.2].groupby("module").agg(names=("names", "first"), explained=("explained", "first"))
    assert sorted(low.names) == [2, 3] and (low.explained > 0.98).all() and set(out[out.cut == 3.0].names) == {5} and len(out) == 60


def workbook(path, rows, sheet="Data", shared=True):
    texts, body = [], ""
    for r, row in rows.items():
        cell = ""
        for ref, v in row.items():
            if isinstance(v, bool):
                cell += f'<c r="{ref}{r}" t="b"><v>{int(v)}</v></c>'
            elif isinstance(v, str) and v.startswith("#"):
                cell += f'<c r="{ref}{r}" t="e"><v>{v}</v></c>'
            elif isinstance(v, str) and shared:
                texts.append(v)
                cell += f'<c r="{ref}{r}" t="s"><v>{len(texts) - 1}</v></c>'
            elif isinstance(v, str):
                cell += f'<c r="{ref}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
            else:
                cell += f'<c r="{ref}{r}"><v>{v}</v></c>'
        body += f'<row r="{r}">{cell}</row>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Other" sheetId="1" r:id="a"/><sheet name="{sheet}" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r><rPh><t>no</t></rPh></si>" for t in texts) + "</sst>")


def test_excel_sheets(spark, tmp_path):
    rows = {1: {"A": "a title above"}, 3: {"A": "gene", "B": "lfc", "C": "", "D": "lfc", "AB": "kept"}, 4: {"A": "TP53", "B": 1.5, "D": -2, "AB": True}, 6: {"B": "#N/A"}, 7: {"A": "MYC", "C": "no name", "AB": "x & y".replace("&", "and")}}
    for k, shared in enumerate((True, False)):
        workbook(f"{tmp_path}/b{k}.xlsx", rows, shared=shared)
    got = sheets.excel(spark, [f"{tmp_path}/b0.xlsx", f"{tmp_path}/b1.xlsx"], "Data", skip=2)
    assert got.columns == ["file", "gene", "lfc", "lfc_2", "kept"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted([("TP53", "1.5", "-2", "true"), ("MYC", None, None, "x and y")] * 2)
    with pytest.raises(ValueError):
        sheets.excel(spark, [f"{tmp_path}/b0.xlsx"], "Nowhere")
    with pytest.raises(ValueError):
        sheets.excel(spark, [f"{tmp_path}/b0.xlsx"], "Other")
    workbook(f"{tmp_path}/c.xlsx", {1: {"A": "other"}})
    with pytest.raises(Exception):
        sheets.excel(spark, [f"{tmp_path}/c.xlsx", f"{tmp_path}/b0.xlsx"], "Data").collect()


def test_semi_synthetic_replicates(spark):
    x = RND.normal(size=(1500, 8)) * np.arange(1, 9) + 5
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "id bigint, x array<double>").repartition(5)
    take = lambda **k: {r.id: (np.array(r.a), np.array(r.b)) for r in freeze.semi_synthetic(df, 3, **k).collect()}
    out = take(share=0.5, reliability=0.7, seed=2)
    a, b = (np.concatenate([out[i][k] for i in range(1500)]) for k in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1] - 0.7) < 0.03
    again = take(share=0.5, reliability=0.7, seed=2)
    assert all(np.allclose(out[i][0], again[i][0]) for i in range(0, 1500, 100))
    pure = take(share=1.0, reliability=1.0, seed=2)
    s = np.stack([pure[i][0] for i in range(1500)])
    z = (x - x.mean(0)) / x.std(0)
    left = s - z @ np.linalg.lstsq(z, s, rcond=None)[0]  # all of it follows from the rows, on three axes
    assert np.linalg.matrix_rank(s, tol=1e-6) == 3 and abs(left).max() < 1e-6 and np.allclose(pure[7][0], pure[7][1])


def test_tables_and_digests_of_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, t string")
    files.save_table(df, f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.schema(df.schema).option("header", True).csv(f"{tmp_path}/t").collect())) == [(1, "a,b"), (2, None)]
    big = bytes(range(256)) * 40_000  # more than one stretch
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "big.bin").write_bytes(big)
    (tmp_path / "d" / "none.bin").write_bytes(b"")
    got = {r.name: (r.bytes, r.sha256) for r in files.inventory(spark, f"{tmp_path}/d").collect()}
    assert got == {"big.bin": (len(big), hashlib.sha256(big).hexdigest()), "none.bin": (0, hashlib.sha256(b"").hexdigest())}
