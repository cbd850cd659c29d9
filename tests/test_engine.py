"""Identities, leak-proofness, dense solves against NumPy, files and streams."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.functions import expr as X
from gridstone.operators import cohort, decompose, design, inference, interaction, metrics, models
from gridstone.sources import files
from gridstone.sources.facts import facts, table
from gridstone.streaming.events import run_to_end, windowed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fact(spark):
    return facts(spark, SF, "r_name").cache()


def test_interaction_sums_to_zero(fact):
    g = interaction.two_way(fact)
    for keys in (["replicate", "feature", "context"], ["replicate", "feature", "intervention"]):
        assert g.groupBy(*keys).agg(F.abs(F.sum("gamma")).alias("s")).agg(F.max("s")).first()[0] < 1e-8


def test_three_way_parts_vanish_over_each_axis(spark):
    rows = [(a, b, c, float((a * 7 + b * 3 + c * c * a) % 11)) for a in range(3) for b in range(4) for c in range(5)]
    df = interaction.three_way(spark.createDataFrame(rows, "a int, b int, c int, v double"), "a", "b", "c", "v", [])
    for axis in ("a", "b", "c"):
        rest = [x for x in "abc" if x != axis]
        assert df.groupBy(*rest).agg(F.abs(F.sum("abc")).alias("s")).agg(F.max("s")).first()[0] < 1e-9


def test_strict_mean_never_sees_the_held_out_value(fact):
    loud = fact.withColumn("value", F.when(F.col("context") == "ASIA", F.col("value") * 1e12).otherwise(F.col("value")))
    keep = lambda df: interaction.strict_leave_one_out_mean(df).filter("context = 'ASIA'").select("replicate", "intervention", "feature", "loo")
    assert keep(fact).exceptAll(keep(loud)).isEmpty() and keep(loud).exceptAll(keep(fact)).isEmpty()


def test_affine_weights_follow_numpy_and_leave_the_target_out(fact):
    g = interaction.context_gram(interaction.gram(interaction.two_way(fact), "gamma"))
    w = models.fit_affine(g, 0.1).toPandas()
    assert np.allclose(w.groupby("context").weight.sum(), 1) and not (w.context == w.source).any()
    loud = g.withColumn("dot", F.when((F.col("ctx_a") == "ASIA") & (F.col("ctx_b") == "ASIA"), 1e12).otherwise(F.col("dot")))
    again = models.fit_affine(loud, 0.1).toPandas()
    one = lambda t: t[t.context == "ASIA"].sort_values("source").weight.to_numpy()
    assert (one(w) == one(again)).all()


def test_gram_energy_is_the_vector_form(fact):
    g = interaction.two_way(fact).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    names = [r.context for r in g.select("context").distinct().orderBy("context").collect()]
    w = g.sparkSession.createDataFrame([(c, 1.0 if i == 0 else -0.25) for i, c in enumerate(names)], "context string, w double")
    by_gram = {r.intervention: r.energy for r in interaction.residual_energy(interaction.gram(g), w).collect()}
    v = g.join(w, "context").groupBy("replicate", "intervention", "feature").agg(F.sum(F.col("value") * F.col("w")).alias("x"))
    a, b = (v.filter(F.col("replicate") == k).select("intervention", "feature", F.col("x").alias(f"x{k}")) for k in (0, 1))
    for r in a.join(b, ["intervention", "feature"]).groupBy("intervention").agg(F.sum(F.col("x0") * F.col("x1")).alias("e")).collect():
        assert abs(by_gram[r.intervention] - r.e) < 1e-8


def test_kernel_ridge_against_numpy(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(30, 4))
    y = x[:, 0] - x[:, 1] ** 2
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(30)], "id long, x array<double>, y double")
    folds = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, fold int")
    got = {r.id: r.prediction for r in models.kernel_ridge(df, folds, 0.1, 4).collect()}
    for k in range(3):
        tr = np.array([i % 3 != k for i in range(30)])
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        width = np.median(d[np.ix_(tr, tr)][d[np.ix_(tr, tr)] > 0])
        kern = np.exp(-d / width)
        w = np.linalg.solve(kern[np.ix_(tr, tr)] + 0.1 * np.eye(tr.sum()), y[tr] - y[tr].mean())
        for i in np.flatnonzero(~tr):
            assert abs(got[i] - (y[tr].mean() + kern[i, tr] @ w)) < 1e-8


def test_known_answers(spark):
    df = spark.createDataFrame([(1, i, float(i), float(9 - i)) for i in range(5)], "u int, i int, x double, y double")
    assert metrics.kendall(df, "u", "i", "x", "y").first().tau == -1
    tables = spark.createDataFrame([(3, 1, 1, 3), (0, 5, 5, 0)], "a int, b int, c int, d int")
    got = [r.p for r in tables.select(inference.fisher_greater("a", "b", "c", "d").alias("p")).collect()]
    assert abs(got[0] - 17 / 70) < 1e-12 and got[1] == 1.0
    assert spark.range(1).select(X.treatment(F.lit("[('drug x', 5.0, 'uM')]")).alias("t")).first().t.concentration == 5.0
    assert spark.range(1).select(X.treatment(F.lit("[('a', 1, 'b'), ('c', 2, 'd')]")).alias("t")).first().t is None
    with pytest.raises(Exception, match="not a flag"):
        spark.range(1).select(X.parse_bool(F.lit("maybe"))).collect()
    with pytest.raises(Exception, match="unmapped key"):
        cohort.many_to_one(spark.range(3).withColumnRenamed("id", "k"), spark.range(2).selectExpr("id as k", "id as v"), "k").collect()


def test_weights_of_matched_controls_sum_to_zero(spark):
    e = table(spark, SF, "events").select((F.col("user_id") % 7).alias("donor"), F.col("event_type").alias("state"), F.col("event_id").alias("row"), (F.col("value") > 20).alias("t"))
    w = cohort.matched_control_weights(e.withColumn("u", F.concat_ws("/", F.col("donor").cast("string"), "state")), ["donor", "state"], F.col("t"), "u")
    assert w.groupBy("unit").agg(F.abs(F.sum("weight")).alias("s")).agg(F.max("s")).first()[0] < 1e-8


def test_draws_keep_their_size(spark, fact):
    d = inference.nested_draws(fact, "context", "intervention", 5, "s")
    assert {r.n for r in d.groupBy("draw").agg(F.sum("times").alias("n")).collect()} == {5 * 25}
    again = inference.nested_draws(fact.repartition(3), "context", "intervention", 5, "s")
    assert d.exceptAll(again).isEmpty()


def test_simultaneous_band_holds_every_interval(spark):
    rows = [(k, n, float(np.sin(k * 7 + ord(n)))) for k in range(200) for n in "abc"]
    draws = spark.createDataFrame(rows, "draw int, name string, v double")
    est = draws.groupBy("name").agg(F.avg("v").alias("estimate"))
    for r in inference.simultaneous_band(draws, est, "name", "v").collect():
        assert r.low < r.estimate < r.high
    p = inference.empirical_p(draws, est.withColumnRenamed("estimate", "observed"), ["name"], "v")
    assert all(0 < r.p <= 1 for r in p.collect())


def test_ladders_are_nested(spark):
    ladder = design.support_ladder(table(spark, SF, "nation"), "n_name", 2, [2, 4])
    small, large = (ladder.filter(F.col("rung") == k).select("held", "sequence", "unit") for k in (2, 4))
    assert small.exceptAll(large).isEmpty() and ladder.filter("held = unit").isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "sets.gmt").write_text("A\turl\tg1\tg2\nB\turl\tg3\n")
    assert {tuple(r) for r in files.gene_sets(spark, str(tmp_path / "sets.gmt")).collect()} == {("A", "g1"), ("A", "g2"), ("B", "g3")}
    with gzip.open(tmp_path / "m.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n% note\n3 2 2\n1 1 5\n3 2 7\n")
    assert {tuple(r) for r in files.matrix_market(spark, str(tmp_path / "m.mtx.gz")).collect()} == {(1, 1, 5.0), (3, 2, 7.0)}
    (tmp_path / "x.soft").write_text("^SERIES = S\n!Series_title = t\n^SAMPLE = G1\n!Sample_title = one\n!Sample_type = RNA\n^SAMPLE = G2\n!Sample_title = two\n")
    assert {tuple(r) for r in files.soft_samples(spark, str(tmp_path / "x.soft")).filter("key = 'Sample_title'").collect()} == {("G1", "Sample_title", "one"), ("G2", "Sample_title", "two")}
    (tmp_path / "w.tsv").write_text("gene\tc1\tc2\ng1\t1\t2\n")
    assert {tuple(r) for r in files.wide_matrix(spark, str(tmp_path / "w.tsv"), "gene").collect()} == {("g1", "c1", 1.0), ("g1", "c2", 2.0)}
    df = files.delimited(spark, str(tmp_path / "w.tsv"), "gene string, c1 int, c2 int", "\t", ["gene", "c2"])
    assert [tuple(r) for r in df.collect()] == [("g1", 2)]
    assert {r.name for r in files.inventory(spark, str(tmp_path)).collect()} >= {"sets.gmt", "w.tsv"}
    out = str(tmp_path / "fact")
    files.save_response(spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0)], "replicate int, context string, value double"), out)
    assert "PartitionFilters: [isnotnull(replicate" in spark.read.parquet(out).filter("replicate = 1")._jdf.queryExecution().toString()
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["p ", "q"], ["p"]))
    assert [r.k for r in files.missing_keys(a, b, ["k"]).collect()] == ["q"]
    assert files.markdown(a).startswith("| k |\n| --- |")


def test_stream_equals_batch(spark):
    t = table(spark, SF, "events").select("ts", "event_type", "value")
    stream = spark.readStream.schema(t.schema).parquet(f"{SF}/events*.parquet")
    got = run_to_end(spark, windowed(stream, "ts", "event_type", "value"), "events_by_hour", "update")
    batch = windowed(t, "ts", "event_type", "value")
    assert got.count() == batch.count() and abs(got.agg(F.sum("total")).first()[0] - batch.agg(F.sum("total")).first()[0]) < 1e-6


def test_filters_reach_the_scan(spark):
    plan = table(spark, SF, "lineitem").filter("l_quantity > 49").select("l_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_decompositions(spark):
    rnd = np.random.default_rng(1)
    u, v = rnd.random((6, 2)), rnd.random((2, 5))
    x = u @ v
    df = spark.createDataFrame([("g", f"r{i}", f"c{j}", float(x[i, j])) for i in range(6) for j in range(5)], "g string, r string, c string, v double")
    got = decompose.pca(df, "g", "r", "c", "v", 2).toPandas()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(np.sqrt((got.score**2).groupby(got.component).sum()), s[:2])
    assert decompose.nmf(df, "g", "r", "c", "v", 2).first().error < 0.02
    b = decompose.random_bases(spark, list("abcd"), 2, 3).toPandas()
    for _, one in b.groupby("draw"):
        m = one.pivot(index="feature", columns="axis", values="weight").to_numpy()
        assert np.allclose(m.T @ m, np.eye(2))
    d = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "a", "c", 9.0), ("g", "b", "c", 9.0)], "g string, a string, b string, d double")
    assert {r.item: r.cluster for r in decompose.linkage(d, "g", 5.0).collect()} == {"a": 0, "b": 0, "c": 1}


def test_completion_never_reads_hidden_entries(spark):
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=8), rnd.normal(size=9)
    rows = [("f", f"c{i}", f"p{j}", float(i + 2 * j + a[i] * b[j])) for i in range(8) for j in range(9)]
    df = spark.createDataFrame(rows, "feature string, context string, intervention string, value double")
    folds = design.latin_masks(df)
    got = decompose.complete_low_rank(df, folds, 1, 1e-3).toPandas()
    assert len(got) == 72 and ((got.value - got.prediction) ** 2).sum() < 0.2 * ((got.value - got.additive) ** 2).sum()
    loud = df.join(folds, ["context", "intervention"]).withColumn("value", F.when(F.col("fold") == 0, F.col("value") * 1e12).otherwise(F.col("value"))).drop("fold")
    again = decompose.complete_low_rank(loud.select(*df.columns), folds, 1, 1e-3).toPandas()
    one = lambda t: t[t.fold == 0].sort_values(["context", "intervention"]).prediction.to_numpy()
    assert (one(got) == one(again)).all()


def test_ridge_leave_one_out_against_numpy(spark):
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(12, 20)), rnd.normal(size=(12, 2))
    df = spark.createDataFrame([(f"u{i:02}", x[i].tolist(), y[i].tolist()) for i in range(12)], "unit string, x array<double>, y array<double>")
    for r in decompose.ridge_leave_one_out(df, [2.0]).collect():
        t = np.arange(12) != int(r.held[1:])
        z = (x - x[t].mean(0)) / x[t].std(0)
        w = np.linalg.solve(z[t].T @ z[t] + 2 * np.eye(20), z[t].T @ (y[t] - y[t].mean(0)))
        assert abs(r.prediction - (y[t].mean(0) + z[~t] @ w)[0, r.output]) < 1e-8


def test_series_matrix(spark, tmp_path):
    (tmp_path / "s.txt").write_text('!Series_title\t"t"\n!Sample_id\t"a"\t"b"\n\n"ID"\t"a"\t"b"\n"g1"\t1.5\t\n"g2"\t2\t3\n!end\n')
    header, cells = files.series_matrix(spark, str(tmp_path / "s.txt"))
    assert {r.key: list(r["values"]) for r in header.collect()} == {"Series_title": ["t"], "Sample_id": ["a", "b"], "end": []}
    assert {tuple(r) for r in cells.collect()} == {("g1", "a", 1.5), ("g1", "b", None), ("g2", "a", 2.0), ("g2", "b", 3.0)}


def test_low_rank_weights_sum_to_one(fact):
    g = interaction.context_gram(interaction.gram(interaction.two_way(fact), "gamma"))
    w = models.fit_affine(g, 0.1, rank=1).toPandas()
    assert np.allclose(w.groupby("context").weight.sum(), 1)
    full, cut = models.fit_affine(g, 0.1).toPandas(), models.fit_affine(g, 0.1, rank=4).toPandas()
    assert np.allclose(full.sort_values(["context", "source"]).weight, cut.sort_values(["context", "source"]).weight)
