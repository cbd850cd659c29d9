"""Queries of nulls, sealed statistics, cohort freezing and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import design, freeze, inference, interaction, metrics, nulls, sealed
from ..sources.facts import facts, sales, table
from .registry import ENERGY, GAMMA, GRAM, PRED, SALES_SQL, energy, gamma, gram, predicted, query, r, rounded, with_facts

HIDDEN = "(ascii(right(context, 1)) + ascii(right(intervention, 1))) % 5 = 0"
UNIFORM = "(('0x' || substr(sha256({}), 1, 13))::BIGINT / 4503599627370496.0)"


def hidden():
    return (F.ascii(F.substring("context", -1, 1)) + F.ascii(F.substring("intervention", -1, 1))) % 5 == 0


def customers(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(r(F.avg("c_acctbal"), 4).alias("x"), F.count(F.lit(1)).cast("double").alias("y"), r(F.avg(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal")).otherwise(0.0)), 4).alias("z"))


CUST = "c AS (SELECT c_nationkey, round(avg(c_acctbal), 4) AS x, count(*)::DOUBLE AS y, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END), 4) AS z FROM customer GROUP BY 1)"


# --- permutation nulls ------------------------------------------------------------------------


@query("permutation_mean", "WITH " + CUST + """, o AS (SELECT avg(x) FILTER (c_nationkey % 2 = 0) - avg(x) FILTER (c_nationkey % 2 <> 0) AS difference, count(*) FILTER (c_nationkey % 2 = 0) AS n FROM c),
p AS (SELECT draw, x, row_number() OVER (PARTITION BY draw ORDER BY sha256('pm|' || draw || '|' || c_nationkey), c_nationkey) AS i FROM c, range(99) t(draw)), d AS (SELECT draw, avg(x) FILTER (i <= n) - avg(x) FILTER (i > n) AS d FROM p, o GROUP BY 1)
SELECT round(any_value(difference), 4) AS difference, round((1 + count(*) FILTER (abs(d) >= abs(difference) - 1e-9 * greatest(1, abs(difference)))) / (1 + count(*)), 6) AS p FROM d, o""")
def _(spark, d):
    return rounded(nulls.permutation_mean_p(customers(spark, d), "c_nationkey", F.col("c_nationkey") % 2 == 0, "x", 99, "pm")).withColumn("difference", r("difference", 4))


@query("sign_flip_max_t", "WITH " + CUST + ", m AS (SELECT c_nationkey, x - avg(x) OVER () + 200 AS x, y - avg(y) OVER () + 0.5 AS y FROM c), f AS (SELECT draw, CASE WHEN " + UNIFORM.format("'sf|' || draw || '|' || c_nationkey") + """ < 0.5 THEN -1.0 ELSE 1.0 END AS s, x, y FROM m, range(99) t(draw)),
t AS (SELECT draw, greatest(abs(avg(s * x) * sqrt(count(*)) / stddev_samp(s * x)), abs(avg(s * y) * sqrt(count(*)) / stddev_samp(s * y))) AS t FROM f GROUP BY 1), o AS (SELECT unnest(['x', 'y']) AS metric, unnest([avg(x) * sqrt(count(*)) / stddev_samp(x), avg(y) * sqrt(count(*)) / stddev_samp(y)]) AS seen FROM m)
SELECT metric, round(seen, 5) AS seen, round((1 + count(*) FILTER (t >= abs(seen) - 1e-9 * greatest(1, abs(seen)))) / (1 + count(*)), 6) AS p FROM t, o GROUP BY metric, seen""")
def _(spark, d):
    c = customers(spark, d)
    mean = c.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    m = c.join(F.broadcast(mean)).select("c_nationkey", (F.col("x") - F.col("mx") + 200).alias("x"), (F.col("y") - F.col("my") + 0.5).alias("y"))  # one row
    out = nulls.max_t(m, ["x", "y"], nulls.sign_flips(m, "c_nationkey", ["x", "y"], 99, "sf"))
    return out.select("metric", r("seen", 5).alias("seen"), r("p").alias("p"))


PERM = "u AS (SELECT DISTINCT {unit} AS u FROM {frm}), ui AS (SELECT draw, u, row_number() OVER (PARTITION BY draw ORDER BY u) AS i, row_number() OVER (PARTITION BY draw ORDER BY sha256('{seed}|' || draw || '|' || u), u) AS j FROM u, range({n}) t(draw)), pm AS (SELECT a.draw, a.u, b.u AS o FROM ui a JOIN ui b ON a.draw = b.draw AND a.i = b.j)"
PAIRD = GAMMA + ", dd AS (SELECT a.context AS a, b.context AS b, round(sum((a.gamma - b.gamma) ** 2) FILTER (a.replicate = 0), 6) AS x, round(sum((a.gamma - b.gamma) ** 2) FILTER (a.replicate = 1), 6) AS y FROM gam a JOIN gam b ON a.replicate = b.replicate AND a.intervention = b.intervention AND a.feature = b.feature AND a.context < b.context GROUP BY ALL)"


def pair_distances(spark, d):
    g = gamma(spark, d)
    a, b = (g.select("replicate", "intervention", "feature", F.col("context").alias(k), F.col("gamma").alias(f"g{k}")) for k in "ab")
    sq = (F.col("ga") - F.col("gb")) * (F.col("ga") - F.col("gb"))
    p = a.join(b, ["replicate", "intervention", "feature"]).filter("a < b").groupBy("a", "b")
    return p.agg(r(F.sum(F.when(F.col("replicate") == 0, sq))).alias("x"), r(F.sum(F.when(F.col("replicate") == 1, sq))).alias("y"))


@query("mantel_alignment", with_facts(PAIRD + ", " + PERM.format(unit="a", frm="(SELECT a FROM dd UNION SELECT b FROM dd)", seed="mt", n=20) + """, al AS (SELECT draw, u, o FROM pm UNION ALL SELECT -1, u, u FROM u),
mv AS (SELECT p.draw, least(p.o, q.o) AS a, greatest(p.o, q.o) AS b, y FROM dd JOIN al p ON p.u = dd.a JOIN al q ON q.u = dd.b AND q.draw = p.draw), k AS (SELECT mv.draw, rank() OVER (PARTITION BY mv.draw ORDER BY dd.x) + (count(*) OVER (PARTITION BY mv.draw, dd.x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY mv.draw ORDER BY mv.y) + (count(*) OVER (PARTITION BY mv.draw, mv.y) - 1) / 2.0 AS ry FROM mv JOIN dd USING (a, b))
SELECT draw::INT AS draw, round(corr(rx, ry), 6) AS spearman FROM k GROUP BY 1"""))
def _(spark, d):
    return rounded(nulls.mantel(pair_distances(spark, d), "a", "b", "x", "y", 20, "mt"))


CROSS = GAMMA + ", sc AS (SELECT a.context AS q, b.context AS t, round(sum(a.gamma * b.gamma), 6) AS s FROM gam a JOIN gam b ON a.intervention = b.intervention AND a.feature = b.feature AND a.replicate = 0 AND b.replicate = 1 GROUP BY ALL)"


def cross_scores(spark, d):
    g = gamma(spark, d)
    a, b = (g.filter(F.col("replicate") == k).select("intervention", "feature", F.col("context").alias(n), F.col("gamma").alias(f"g{n}")) for k, n in ((0, "q"), (1, "t")))
    return a.join(b, ["intervention", "feature"]).groupBy("q", "t").agg(r(F.sum(F.col("gq") * F.col("gt"))).alias("s"))


@query("fingerprint_permutation", with_facts(CROSS + ", " + PERM.format(unit="q", frm="sc", seed="fp", n=20) + """, rk AS (SELECT q, t, s, rank() OVER (PARTITION BY q ORDER BY s DESC) AS k, median(s) OVER (PARTITION BY q) AS m FROM sc)
SELECT draw::INT AS draw, round(avg(s - m), 4) AS effect, round(avg((k <= 1)::INT), 6) AS top1, round(avg((k <= 10)::INT), 6) AS top10 FROM pm JOIN rk ON rk.q = pm.u AND rk.t = pm.o GROUP BY 1"""))
def _(spark, d):
    s = cross_scores(spark, d)
    out = nulls.fingerprint_null(s, "q", "t", "s", nulls.permutation(s, "q", 20, "fp"), "draw")
    return rounded(out).withColumn("effect", r("effect", 4))


@query("derangement_null", with_facts(CROSS + ", x AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT q FROM sc)), dr AS (SELECT k AS shift, a.q, b.q AS o FROM x a, range(1, 100) t(k), x b WHERE k < a.n AND b.i = (a.i + k) % a.n) SELECT shift::INT AS shift, round(avg(s), 4) AS matched FROM dr JOIN sc ON sc.q = dr.q AND sc.t = dr.o GROUP BY 1"))
def _(spark, d):
    s = cross_scores(spark, d)
    return rounded(nulls.match_null(s, "q", "t", "s", nulls.shifts(s, "q"), "shift"), digits=4)


MATCHI = GAMMA + ", sc AS (SELECT context, a.intervention AS q, b.intervention AS t, round(sum(a.gamma * b.gamma), 6) AS s FROM gam a JOIN gam b USING (context, feature) WHERE a.replicate = 0 AND b.replicate = 1 GROUP BY ALL)"


@query("replicate_match_null", with_facts(MATCHI + """, u AS (SELECT DISTINCT context, q AS u FROM sc), ui AS (SELECT draw, context, u, row_number() OVER (PARTITION BY draw, context ORDER BY u) AS i, row_number() OVER (PARTITION BY draw, context ORDER BY sha256('rm|' || draw || '|' || u), u) AS j FROM u, range(5) t(draw)),
pm AS (SELECT a.draw, a.context, a.u, b.u AS o FROM ui a JOIN ui b ON a.draw = b.draw AND a.context = b.context AND a.i = b.j) SELECT draw::INT AS draw, pm.context, round(avg(s), 4) AS matched FROM pm JOIN sc ON sc.context = pm.context AND sc.q = pm.u AND sc.t = pm.o GROUP BY ALL""", "r_name"))
def _(spark, d):
    g = gamma(spark, d, "r_name")
    a, b = (g.filter(F.col("replicate") == k).select("context", "feature", F.col("intervention").alias(n), F.col("gamma").alias(f"g{n}")) for k, n in ((0, "q"), (1, "t")))
    s = a.join(b, ["context", "feature"]).groupBy("context", "q", "t").agg(r(F.sum(F.col("gq") * F.col("gt"))).alias("s"))
    pairs = nulls.permutation(s, "q", 5, "rm", ["context"])
    hit = pairs.join(s.withColumnRenamed("t", "other"), ["context", "q", "other"])
    return rounded(hit.groupBy("draw", "context").agg(F.avg("s").alias("matched")), digits=4)


@query("matched_random_items", """WITH w AS (SELECT p_brand, p_size % 4 AS b, count(*) FILTER (p_partkey % 10 = 0) AS n FROM part GROUP BY ALL), p AS (SELECT draw, p_partkey, n, row_number() OVER (PARTITION BY draw, p_brand, b ORDER BY sha256('mr|' || draw || '|' || p_partkey), p_partkey) AS i FROM (SELECT *, p_size % 4 AS b FROM part WHERE p_partkey % 10 <> 0) JOIN w USING (p_brand, b), range(3) t(draw))
SELECT draw::INT AS draw, p_partkey FROM p WHERE i <= n""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 4).alias("b"))
    return nulls.matched_random(p, "p_partkey", F.col("p_partkey") % 10 == 0, ["p_brand", "b"], 3, "mr")


@query("random_comparator", with_facts(PAIRD + """, s AS (SELECT a AS u, b AS v, x FROM dd UNION ALL SELECT b, a, x FROM dd), o AS (SELECT avg(m) AS observed FROM (SELECT u, min(x) AS m FROM s GROUP BY 1)), n AS (SELECT draw, avg(x) AS d FROM (SELECT draw, x, row_number() OVER (PARTITION BY draw, u ORDER BY sha256('rc|' || draw || '|' || u || '|' || v), v) AS i FROM s, range(50) t(draw)) WHERE i = 1 GROUP BY 1)
SELECT round(any_value(observed), 4) AS observed, round((1 + count(*) FILTER (observed >= d - 1e-9 * greatest(1, abs(d)))) / (1 + count(*)), 6) AS p FROM n, o"""))
def _(spark, d):
    p = pair_distances(spark, d)
    s = p.select(F.col("a").alias("u"), F.col("b").alias("v"), "x").unionByName(p.select(F.col("b").alias("u"), F.col("a").alias("v"), "x"))
    out = nulls.random_comparator(s, "u", "v", "x", s.groupBy("u").agg(F.min("x").alias("x")), 50, "rc")
    return out.select(r("observed", 4).alias("observed"), r("p").alias("p"))


# --- draws ------------------------------------------------------------------------------------

DRAWS = "ax AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {unit} AS u FROM {frm})), dw AS (SELECT draw, ax.u, count(*) AS times FROM (SELECT draw, floor(" + UNIFORM.format("'{seed}|' || draw || '|' || ax.i") + " * ax.n)::INT AS i FROM ax, range({n}) t(draw)) pk JOIN ax USING (i) GROUP BY ALL)"


@query("crossed_bootstrap", "WITH s AS (SELECT s_nationkey % 5 AS a, s_suppkey % 7 AS b, avg(s_acctbal) AS v FROM supplier GROUP BY ALL), " + DRAWS.format(unit="a", frm="s", seed="ca", n=20) + ", ax2 AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT b AS u FROM s)), dw2 AS (SELECT draw, ax2.u, count(*) AS times FROM (SELECT draw, floor(" + UNIFORM.format("'cb|' || draw || '|' || ax2.i") + " * ax2.n)::INT AS i FROM ax2, range(20) t(draw)) pk JOIN ax2 USING (i) GROUP BY ALL) SELECT dw.draw::INT AS draw, round(sum(dw.times * dw2.times * v) / sum(dw.times * dw2.times), 4) AS mean FROM dw JOIN dw2 USING (draw) JOIN s ON s.a = dw.u AND s.b = dw2.u GROUP BY 1")
def _(spark, d):
    s = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 5).alias("a"), (F.col("s_suppkey") % 7).alias("b")).agg(F.avg("s_acctbal").alias("v"))
    w = nulls.crossed_draws(inference.unit_draws(s, "a", 20, "ca"), inference.unit_draws(s, "b", 20, "cb"))
    return rounded(w.join(s, ["a", "b"]).groupBy("draw").agg((F.sum(F.col("times") * F.col("v")) / F.sum("times")).alias("mean")), digits=4)


@query("block_bootstrap", "WITH ax AS (SELECT c_mktsegment AS s, c_nationkey AS k, c_custkey AS u, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer), pk AS (SELECT draw, s, k, floor(" + UNIFORM.format("'bb|' || draw || '|' || s || '|' || k || '|' || i") + " * n)::INT AS i FROM ax, range(3) t(draw)) SELECT draw::INT AS draw, s AS c_mktsegment, k AS c_nationkey, u AS c_custkey, count(*) AS times FROM pk JOIN ax USING (s, k, i) GROUP BY ALL")
def _(spark, d):
    return nulls.block_draws(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", 3, "bb")


MODELS = ENERGY + ", ml AS (SELECT context, 'a' AS model, sum(s) AS s, sum(e) AS e FROM en GROUP BY 1 UNION ALL SELECT context, 'b', sum(s), sum(e) * 0.9 + 0.01 * length(context) FROM en GROUP BY 1)"


def model_energies(spark, d):
    e = energy(spark, d).groupBy("context").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    return e.select("context", F.lit("a").alias("model"), "s", "e").unionByName(e.select("context", F.lit("b").alias("model"), "s", (F.col("e") * 0.9 + 0.01 * F.length("context")).alias("e")))


@query("model_differences", with_facts(GAMMA + MODELS + ", " + DRAWS.format(unit="context", frm="ml", seed="md", n=30) + ", g AS (SELECT draw, model, CASE WHEN sum(times * s) > 0 THEN 1 - sum(times * e) / sum(times * s) END AS g FROM dw JOIN ml ON ml.context = dw.u GROUP BY ALL) SELECT b.draw::INT AS draw, b.model, round(b.g - a.g, 4) AS difference FROM g b JOIN g a ON a.draw = b.draw AND a.model = 'a' AND b.model = 'b'"))
def _(spark, d):
    m = model_energies(spark, d)
    return rounded(nulls.model_differences(inference.unit_draws(m, "context", 30, "md"), m, "context", "model", "a"), digits=4)


@query("subset_medians", with_facts(GAMMA + ENERGY + ", ml AS (SELECT intervention, sum(s) AS s, sum(e) AS e FROM en GROUP BY 1), sb AS (SELECT DISTINCT intervention, (ascii(right(intervention, 1)) + k) % 4 AS subset, k FROM ml, range(1, 4) t(k)), " + DRAWS.format(unit="intervention", frm="ml", seed="sm", n=10) + ", g AS (SELECT draw, subset, k, CASE WHEN sum(times * s) > 0 THEN 1 - sum(times * e) / sum(times * s) END AS g FROM dw JOIN ml ON ml.intervention = dw.u JOIN sb USING (intervention) GROUP BY ALL) SELECT draw::INT AS draw, k::INT AS k, round(median(g), 4) AS g FROM g GROUP BY ALL"))
def _(spark, d):
    m = energy(spark, d).groupBy("intervention").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    sets = m.select("intervention", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).withColumn("subset", (F.ascii(F.substring("intervention", -1, 1)) + F.col("k")) % 4)
    return rounded(nulls.subset_medians(inference.unit_draws(m, "intervention", 10, "sm"), m, "intervention", sets), digits=4)


@query("spearman_draws", "WITH p AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS x, p_retailprice AS y FROM part), " + DRAWS.format(unit="p_brand", frm="p", seed="sd", n=10) + """, e AS (SELECT draw, x, y FROM dw JOIN p ON p_brand = u, range(1, 1000) t(k) WHERE k <= times),
k AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY x) + (count(*) OVER (PARTITION BY draw, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY draw ORDER BY y) + (count(*) OVER (PARTITION BY draw, y) - 1) / 2.0 AS b FROM e) SELECT draw::INT AS draw, round(corr(a, b), 5) AS spearman FROM k GROUP BY 1""")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(nulls.spearman_draws(inference.unit_draws(p, "p_brand", 10, "sd"), p, ["p_brand"], "x", "y"), digits=5)


@query("pair_draws", with_facts(PAIRD + ", " + DRAWS.format(unit="a", frm="(SELECT a FROM dd UNION SELECT b FROM dd)", seed="pd", n=20) + " SELECT p.draw::INT AS draw, round(sum(p.times * q.times * x) / sum(p.times * q.times), 4) AS mean FROM dd JOIN dw p ON p.u = dd.a JOIN dw q ON q.u = dd.b AND q.draw = p.draw GROUP BY 1"))
def _(spark, d):
    p = pair_distances(spark, d)
    units = p.select(F.col("a").alias("context")).unionByName(p.select(F.col("b").alias("context")))
    return rounded(nulls.pair_draws(inference.unit_draws(units, "context", 20, "pd"), p, "context", "x"), digits=4)


@query("partition_mean_draws", "WITH p AS (SELECT p_brand, p_size % 3 AS part3, round(avg(p_retailprice), 4) AS v FROM part GROUP BY ALL), " + DRAWS.format(unit="p_brand", frm="p", seed="pp", n=20) + " SELECT draw::INT AS draw, round(avg(m), 4) AS mean FROM (SELECT draw, part3, sum(times * v) / sum(times) AS m FROM dw JOIN p ON p_brand = u GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", (F.col("p_size") % 3).alias("part3")).agg(r(F.avg("p_retailprice"), 4).alias("v"))
    return rounded(nulls.partition_mean_draws(inference.unit_draws(p, "p_brand", 20, "pp"), p, "p_brand", "part3", "v"), digits=4)


@query("pooled_ratio_draws", with_facts(PRED + ", s AS (SELECT context, replicate AS seed, sum(value * pred) AS tp, sum(value * value) AS tt, sum(pred * pred) AS pp FROM p GROUP BY ALL), " + DRAWS.format(unit="context", frm="s", seed="pr", n=20) + ", m AS (SELECT draw, seed, sum(times * tp) AS tp, sum(times * tt) AS tt, sum(times * pp) AS pp FROM dw JOIN s ON context = u GROUP BY ALL) SELECT draw::INT AS draw, round(avg(tp / tt), 6) AS alpha, round(avg(sqrt(pp / tt)), 6) AS kappa, round(avg(tp / sqrt(tt * pp)), 6) AS cosine FROM m GROUP BY 1"))
def _(spark, d):
    p = predicted(spark, d)
    s = sealed.parallel_orthogonal(p, ["context", "replicate"], "value", "loo").withColumnRenamed("replicate", "seed")
    return rounded(nulls.pooled_draws(inference.unit_draws(s, "context", 20, "pr"), s, "context", "seed"))


@query("null_summary", "WITH " + CUST + """, p AS (SELECT draw, x, row_number() OVER (PARTITION BY draw ORDER BY sha256('ns|' || draw || '|' || c_nationkey), c_nationkey) AS i FROM c, range(60) t(draw)), n AS (SELECT draw, 'first half' AS family, avg(x) FILTER (i <= 12) AS v FROM p GROUP BY 1 UNION ALL SELECT draw, 'spread', max(x) FILTER (i <= 12) - min(x) FILTER (i <= 12) FROM p GROUP BY 1),
o AS (SELECT 'first half' AS family, avg(x) AS observed FROM c UNION ALL SELECT 'spread', max(x) - min(x) FROM c) SELECT family, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS sd, round(quantile_cont(v, 0.95), 3) AS p95, round(any_value(observed) - avg(v), 3) AS effect, round((1 + count(*) FILTER (v >= observed - 1e-9 * greatest(1, abs(observed)))) / (1 + count(*)), 6) AS p FROM n JOIN o USING (family) GROUP BY 1""")
def _(spark, d):
    c = customers(spark, d)
    units = c.select("c_nationkey", "x")
    i = F.row_number().over(Window.partitionBy("draw").orderBy(F.sha2(F.concat_ws("|", F.lit("ns"), F.col("draw").cast("string"), F.col("c_nationkey").cast("string")), 256), "c_nationkey"))
    p = nulls.in_draws(units, 60).withColumn("i", i).filter("i <= 12").groupBy("draw").agg(F.avg("x").alias("first half"), (F.max("x") - F.min("x")).alias("spread")).unpivot(["draw"], ["first half", "spread"], "family", "v")
    o = c.agg(F.avg("x").alias("first half"), (F.max("x") - F.min("x")).alias("spread")).unpivot([], ["first half", "spread"], "family", "observed")
    return rounded(nulls.null_summary(p, o, ["family"], "v"), "p", digits=3).withColumn("p", r("p"))


BAND = "WITH p AS (SELECT p_brand, p_size % 3 AS name, p_size % 2 AS family, round(avg(p_retailprice), 4) AS v FROM part GROUP BY ALL), " + DRAWS.format(unit="p_brand", frm="p", seed="lb", n=40) + ", dr AS (SELECT draw, family, name, sum(times * v) / sum(times) AS m FROM dw JOIN p ON p_brand = u GROUP BY ALL), es AS (SELECT family, name, avg(v) AS estimate FROM p GROUP BY ALL), se AS (SELECT family, name, stddev_samp(m) AS se, any_value(estimate) AS estimate FROM dr JOIN es USING (family, name) GROUP BY ALL)"


def band(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", (F.col("p_size") % 3).alias("name"), (F.col("p_size") % 2).alias("family")).agg(r(F.avg("p_retailprice"), 4).alias("v"))
    draws = inference.unit_draws(p, "p_brand", 40, "lb").join(p, "p_brand").groupBy("draw", "family", "name").agg((F.sum(F.col("times") * F.col("v")) / F.sum("times")).alias("m"))
    return draws, p.groupBy("family", "name").agg(F.avg("v").alias("estimate"))


@query("family_lower_band", BAND + ", t AS (SELECT family, draw, max((estimate - m) / se) AS t FROM dr JOIN se USING (family, name) GROUP BY ALL), cr AS (SELECT family, quantile_cont(t, 0.95) AS crit FROM t GROUP BY 1) SELECT family, name, round(estimate, 3) AS estimate, round(estimate - crit * se, 3) AS low, estimate - crit * se > 100 AS passed FROM se JOIN cr USING (family)")
def _(spark, d):
    draws, est = band(spark, d)
    return rounded(nulls.not_inferior(nulls.lower_band(draws, est, "name", "m", family="family"), -100.0), digits=3)


@query("lower_band", BAND + ", d0 AS (SELECT draw, family * 10 + name AS name, m, se, estimate FROM dr JOIN se USING (family, name)), t AS (SELECT draw, max((estimate - m) / se) AS t FROM d0 GROUP BY 1), cr AS (SELECT quantile_cont(t, 0.95) AS crit FROM t) SELECT family * 10 + name AS name, round(estimate, 3) AS estimate, round(estimate - crit * se, 3) AS low FROM se, cr")
def _(spark, d):
    """One family of all names."""
    draws, est = band(spark, d)
    name = (F.col("family") * 10 + F.col("name")).alias("name")
    return rounded(nulls.lower_band(draws.select(name, "draw", "m"), est.select(name, "estimate"), "name", "m"), digits=3)


@query("corrected_comparison", BAND + ", k AS (SELECT family * 10 + name AS name, draw, m FROM dr WHERE name < 2), e AS (SELECT family * 10 + name AS name, estimate, se FROM se WHERE name < 2), t AS (SELECT draw, max(abs(m - estimate) / se) AS t FROM k JOIN e USING (name) GROUP BY 1), cr AS (SELECT quantile_cont(t, 0.95) AS crit FROM t) SELECT name, round(estimate, 3) AS estimate, round(estimate - crit * se, 3) AS low, round(estimate + crit * se, 3) AS high FROM e, cr WHERE name < 10")
def _(spark, d):
    """A family of four columns sets the critical value; two of them are reported."""
    draws, est = band(spark, d)
    name = (F.col("family") * 10 + F.col("name")).alias("name")
    four = inference.simultaneous_band(draws.filter("name < 2").select(name, "draw", "m"), est.filter("name < 2").select(name, "estimate"), "name", "m")
    return rounded(four.filter("name < 10"), digits=3)


# --- sealed statistics ------------------------------------------------------------------------------


@query("parallel_orthogonal", with_facts(PRED + " SELECT context, round(sum(value * pred), 3) AS tp, round(sum(value * value), 3) AS tt, round(sum(pred * pred), 3) AS pp, round(sum(value * pred) ** 2 / sum(value * value), 3) AS parallel, round(sum(pred * pred) - sum(value * pred) ** 2 / sum(value * value), 3) AS orthogonal FROM p GROUP BY 1"))
def _(spark, d):
    return rounded(sealed.parallel_orthogonal(predicted(spark, d), ["context"], "value", "loo"), digits=3)


@query("library_contrast", "WITH m AS (SELECT p_brand, l_returnflag AS f, l_linestatus AS lib, l_orderkey % 2 AS h, avg(l_quantity) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), l AS (SELECT p_brand, f, h, arg_max(m, lib) - arg_min(m, lib) AS d FROM m GROUP BY ALL HAVING count(*) = 2), b AS (SELECT p_brand, f, arg_max(d, h) AS a, arg_min(d, h) AS b FROM l GROUP BY ALL HAVING count(*) = 2) SELECT p_brand, round(sum(a * b) / 4, 5) AS signal, count(*) AS features FROM b GROUP BY 1")
def _(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("h", F.col("l_orderkey") % 2)
    return rounded(sealed.library_contrast(l, ["p_brand"], "l_linestatus", "h", "l_returnflag", "l_quantity"), digits=5)


WEIGHTS = ", w AS (SELECT a.c AS context, b.c AS source, 1.0 / (count(*) OVER (PARTITION BY a.c)) AS weight FROM (SELECT DISTINCT context AS c FROM fact) a JOIN (SELECT DISTINCT context AS c FROM fact) b ON a.c <> b.c), pd AS (SELECT f.replicate, w.context, f.intervention, f.feature, sum(weight * f.value) AS p, avg(f.value) AS m FROM w JOIN fact f ON f.context = w.source GROUP BY ALL), bo AS (SELECT f.*, p, m FROM fact f JOIN pd USING (replicate, context, intervention, feature))"


def equal_weights(f):
    c = f.select("context").distinct()
    pairs = c.join(c.withColumnRenamed("context", "source"), F.col("context") != F.col("source"))  # contexts of the design
    return pairs.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("context")))


@query("same_replicate_stats", with_facts(WEIGHTS + " SELECT context, replicate, round(sum(p * p), 2) AS norm, round(sum(value * p), 2) AS dot, round(sum(p), 2) AS total FROM bo GROUP BY ALL", "r_name"))
def _(spark, d):
    f = facts(spark, d, "r_name")
    return rounded(sealed.same_stats(f, equal_weights(f)), digits=2)


@query("excess_stats", with_facts(WEIGHTS.replace("1.0 / (count(*) OVER (PARTITION BY a.c))", "length(b.c)::DOUBLE / sum(length(b.c)) OVER (PARTITION BY a.c)") + " SELECT context, replicate, round(sum((p - m) ** 2), 4) AS norm, round(sum((value - m) * (p - m)), 4) AS dot, round(sum(p - m), 4) AS total FROM bo GROUP BY ALL", "r_name"))
def _(spark, d):
    f = facts(spark, d, "r_name")
    w = equal_weights(f).withColumn("weight", F.length("source") / F.sum(F.length("source")).over(Window.partitionBy("context")))
    return rounded(sealed.same_stats(f, w, excess=True), digits=4)


@query("offset_stats", with_facts(PRED + ", e AS (SELECT *, value - pred AS e, ascii(right(intervention, 1)) % 3 = 0 AS s FROM p), o AS (SELECT replicate, context, feature, avg(e) AS o FROM e WHERE s GROUP BY ALL) SELECT context, round(sum(o * o), 3) AS \"offset\", round(sum(e * o), 3) AS \"cross\", round(sum((e - 0.5 * o) ** 2), 3) AS residual FROM e JOIN o USING (replicate, context, feature) WHERE NOT s GROUP BY 1"))
def _(spark, d):
    return rounded(sealed.offset_stats(predicted(spark, d), "loo", F.ascii(F.substring("intervention", -1, 1)) % 3 == 0, 0.5), digits=3)


@query("identity_null", with_facts(PRED + ", x AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT intervention AS i FROM p)), dr AS (SELECT h AS shift, a.i AS intervention, b.i AS o FROM x a, range(1, 100) t(h), x b WHERE h < a.n AND b.k = (a.k + h) % a.n) SELECT shift::INT AS shift, p.context, round(sum((p.value - q.pred) ** 2), 2) AS residual FROM p JOIN dr USING (intervention) JOIN p q ON q.replicate = p.replicate AND q.context = p.context AND q.feature = p.feature AND q.intervention = dr.o GROUP BY ALL"))
def _(spark, d):
    p = predicted(spark, d)
    return rounded(sealed.identity_null(p, "loo", nulls.shifts(p, "intervention")), digits=2)


@query("masked_baseline", with_facts(f", s AS (SELECT replicate, intervention, feature, avg(value) AS baseline, count(*) AS sources FROM fact WHERE NOT ({HIDDEN}) GROUP BY ALL) SELECT context, count(*) AS cells, min(sources) AS fewest, round(sum(value * baseline), 2) AS \"cross\", round(sum(baseline * baseline), 2) AS norm FROM fact JOIN s USING (replicate, intervention, feature) WHERE {HIDDEN} GROUP BY 1"))
def _(spark, d):
    b = sealed.masked_baseline(facts(spark, d), hidden()).filter("baseline is not null")
    return rounded(b.groupBy("context").agg(F.count(F.lit(1)).alias("cells"), F.min("sources").alias("fewest"), F.sum(F.col("value") * F.col("baseline")).alias("cross"), F.sum(F.col("baseline") * F.col("baseline")).alias("norm")), digits=2)


FILLED = f", s AS (SELECT *, {HIDDEN} AS h FROM fact), fl AS (SELECT s.replicate, s.context, s.intervention, s.feature, s.h, CASE WHEN h THEN coalesce(r, g) + coalesce(c, g) - g ELSE value END AS v FROM s LEFT JOIN (SELECT replicate, feature, context, avg(value) AS r FROM s WHERE NOT h GROUP BY ALL) USING (replicate, feature, context) LEFT JOIN (SELECT replicate, feature, intervention, avg(value) AS c FROM s WHERE NOT h GROUP BY ALL) USING (replicate, feature, intervention) LEFT JOIN (SELECT replicate, feature, avg(value) AS g FROM s WHERE NOT h GROUP BY ALL) USING (replicate, feature))"


@query("additive_completion", with_facts(FILLED + " SELECT context, feature, count(*) FILTER (h) AS hidden, round(avg(v), 5) AS mean, round(sum(v * v), 2) AS norm FROM fl GROUP BY ALL"))
def _(spark, d):
    f = sealed.additive_completion(facts(spark, d), hidden())
    return f.groupBy("context", "feature").agg(F.count_if("hidden").alias("hidden"), r(F.avg("filled"), 5).alias("mean"), r(F.sum(F.col("filled") * F.col("filled")), 2).alias("norm"))


@query("completed_gram", with_facts(FILLED + " SELECT a.context AS ctx_a, b.context AS ctx_b, round(sum(a.v * b.v), 1) AS dot FROM fl a JOIN fl b USING (replicate, intervention, feature) GROUP BY ALL", "r_name"))
def _(spark, d):
    f = sealed.additive_completion(facts(spark, d, "r_name"), hidden()).select("replicate", "context", "intervention", "feature", F.col("filled").alias("value"))
    return rounded(interaction.context_gram(interaction.gram(f)), digits=1)


@query("low_rank_stats", with_facts(", lo AS (SELECT unnest([0, 0, 1, 1]) AS axis, unnest(['price', 'quantity', 'quantity', 'tax']) AS feature, unnest([0.6, 0.8, 0.8, -0.6]) AS weight), sc AS (SELECT replicate, context, intervention, axis, sum(value * weight) AS score FROM fact JOIN lo USING (feature) GROUP BY ALL) SELECT replicate, context, intervention, round(sum(v * v), 3) AS norm FROM (SELECT replicate, context, intervention, feature, sum(score * weight) AS v FROM sc JOIN lo USING (axis) GROUP BY ALL) GROUP BY ALL", "r_name"))
def _(spark, d):
    lo = spark.createDataFrame([(0, "price", 0.6), (0, "quantity", 0.8), (1, "quantity", 0.8), (1, "tax", -0.6)], "axis int, feature string, weight double")
    a, b = (lo.select("feature", F.col("axis").alias(f"axis_{k}"), F.col("weight").alias(f"w{k}")) for k in "ab")
    g = a.join(b, "feature").groupBy("axis_a", "axis_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return rounded(sealed.low_rank_stats(interaction.project(facts(spark, d, "r_name"), lo), ["replicate", "context", "intervention"], g), digits=3)


@query("operator_similarity", with_facts(GAMMA + " SELECT a.context AS a, b.context AS b, round(sum(a.gamma * b.gamma) / sqrt(sum(a.gamma ** 2) * sum(b.gamma ** 2)), 6) AS cosine FROM gam a JOIN gam b USING (replicate, intervention, feature) WHERE a.context < b.context GROUP BY ALL"))
def _(spark, d):
    g = gamma(spark, d).groupBy("context").agg(F.transform(F.sort_array(F.collect_list(F.struct("replicate", "intervention", "feature", "gamma"))), lambda s: s["gamma"]).alias("xs"))  # a complete design: equal order
    return rounded(sealed.operator_similarity(g, "context"))


@query("sealed_view", with_facts(f" SELECT context, count(*) AS n, round(sum(value), 3) AS total FROM fact WHERE NOT ({HIDDEN}) GROUP BY 1"))
def _(spark, d):
    f = facts(spark, d)
    keys = f.filter(hidden()).select("context", "intervention").distinct()
    seen = sealed.refuse(sealed.sealed(f, keys), keys)
    return rounded(seen.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), digits=3)


@query("precision_gate", with_facts(", g AS (SELECT sum(value * value) AS d, sum((value::FLOAT * value::FLOAT)::DOUBLE) AS f FROM fact GROUP BY replicate, context) SELECT round(max(abs(d - f) / abs(d)), 12) AS worst, max(abs(d - f) / abs(d)) <= 1e-5 AS passed FROM g"))
def _(spark, d):
    return sealed.precision_gate(facts(spark, d), 1e-5).withColumn("worst", r("worst", 12))


@query("kernel_weights")
def _(spark, d):
    return sealed.kernel_weights(interaction.context_gram(gram(spark, d)), 0.1)


@query("nested_penalty")
def _(spark, d):
    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    return sealed.nested_penalty(sealed.by_fold(g, design.stride_folds(g, "intervention", "np")), [0.01, 0.1, 1.0, 10.0])


@query("span_basis")
def _(spark, d):
    lo = facts(spark, d, "r_name").groupBy(F.col("context").alias("axis"), "feature").agg(F.avg("value").alias("weight"))
    return sealed.span_basis(lo)


# --- cohorts, designs, gates ----------------------------------------------------------------------------


@query("support_mask", with_facts(GAMMA + " SELECT feature FROM gam a JOIN gam b USING (context, intervention, feature) WHERE a.replicate = 0 AND b.replicate = 1 AND right(a.context, 1) < '5' GROUP BY 1 HAVING sum(a.gamma ** 2 - (a.gamma - b.gamma) ** 2 / 4) > 0"))
def _(spark, d):
    x = interaction.cross_replicate(gamma(spark, d), "gamma")
    x = x.withColumn("s", F.col("gamma0") * F.col("gamma0")).withColumn("e", (F.col("gamma0") - F.col("gamma1")) * (F.col("gamma0") - F.col("gamma1")) / 4)
    return freeze.support_mask(x, "feature", "s", "e", F.substring("context", -1, 1) < "5")


@query("top_variance", "WITH v AS (SELECT p_brand, min(p_partkey) AS place, round(var_pop(p_retailprice), 9) AS variance FROM part GROUP BY 1) SELECT p_brand, round(variance, 2) AS variance FROM v ORDER BY v.variance DESC, place DESC LIMIT 10")
def _(spark, d):
    p = table(spark, d, "part")
    place = p.groupBy("p_brand").agg(F.min("p_partkey").alias("place"))
    return rounded(freeze.top_variance(p.join(place, "p_brand"), "p_brand", "place", "p_retailprice", 10), digits=2)


CORE = "cel AS (SELECT n_name, p_brand, count(*) AS n FROM sale GROUP BY ALL), k AS (SELECT least, n_name, p_brand, n FROM cel, (VALUES (1), (5), (20), (60), (100)) v(least) WHERE n >= least), cx AS (SELECT least, count(DISTINCT n_name) AS contexts FROM k GROUP BY 1), cm AS (SELECT least, p_brand FROM k JOIN cx USING (least) GROUP BY least, p_brand HAVING 2 * count(*) >= any_value(contexts)), wa AS (SELECT least, count(*) AS interventions FROM cm GROUP BY 1), hv AS (SELECT k.least, n_name, count(*) AS have, min(n) AS fewest FROM k JOIN cm USING (least, p_brand) GROUP BY ALL), co AS (SELECT least, interventions, count(*) AS contexts, min(fewest) AS fewest FROM hv JOIN wa USING (least) WHERE have = interventions GROUP BY ALL)"


@query("core_candidates", SALES_SQL + ", " + CORE + " SELECT row_number() OVER (ORDER BY contexts DESC, interventions DESC, fewest DESC, least)::INT AS place, least, contexts, interventions, fewest, contexts >= 2 AND interventions >= 2 AS passed FROM co")
def _(spark, d):
    return freeze.core_candidates(sales(spark, d), "n_name", "p_brand", [1, 5, 20, 60, 100])


@query("frozen_cohort", SALES_SQL + ", e AS (SELECT p_brand, count(*) AS n, count(DISTINCT r_name) AS have, count(DISTINCT r_name) FILTER (l_discount = 0) AS controls, avg(l_quantity) FILTER (l_discount <> 0) AS mean FROM sale GROUP BY 1), q AS (SELECT quantile_cont(n, 0.1) AS lo, quantile_cont(n, 0.9) AS hi FROM e) SELECT p_brand, row_number() OVER (ORDER BY p_brand)::INT AS place, n, round(mean, 5) AS mean FROM e, q WHERE have = (SELECT count(DISTINCT r_name) FROM sale) AND controls = have AND n BETWEEN lo AND hi")
def _(spark, d):
    return rounded(freeze.frozen_cohort(sales(spark, d), "p_brand", "r_name", F.col("l_discount") == 0, "l_quantity", 0.1, 0.9), digits=5)


@query("replicate_core", SALES_SQL + ", e AS (SELECT n_name, p_brand, replicate, count(*) AS n FROM sale GROUP BY ALL HAVING count(*) >= 20) SELECT n_name || ' ' || p_brand AS unit, min(n) AS fewest FROM e GROUP BY 1 HAVING count(*) = 2")
def _(spark, d):
    return freeze.replicate_core(sales(spark, d).withColumn("unit", F.concat_ws(" ", "n_name", "p_brand")), "unit", "replicate", 20)


@query("domain_split", "SELECT r.n_regionkey AS held, n_name, CASE WHEN n.n_regionkey = r.n_regionkey THEN 'outer_test' ELSE 'outer_train' END AS role FROM nation n, (SELECT DISTINCT n_regionkey FROM nation) r")
def _(spark, d):
    return freeze.domain_split(table(spark, d, "nation"), "n_name", "n_regionkey")


@query("axis_audit", with_facts(" SELECT replicate, context, count(*) AS n, count(DISTINCT intervention) AS n_intervention, count(DISTINCT feature) AS n_feature, count(*) FILTER (value IS NULL) AS missing, round(max(value) - min(value), 5) AS span, count(*) = count(DISTINCT intervention) * count(DISTINCT feature) AS complete FROM fact GROUP BY ALL"))
def _(spark, d):
    return rounded(freeze.axis_audit(facts(spark, d), ["replicate", "context"], ["intervention", "feature"], "value"), digits=5)


@query("mapping_check", "WITH a AS (SELECT c_nationkey AS k, min(c_mktsegment) AS a, count(DISTINCT c_mktsegment) AS na FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, min(c_mktsegment) AS b, count(DISTINCT c_mktsegment) AS nb FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1), c AS (SELECT c_nationkey AS k, min(c_mktsegment) AS c, count(DISTINCT c_mktsegment) AS nc FROM customer WHERE c_custkey % 3 = 2 GROUP BY 1) SELECT k AS c_nationkey, a, b, c FROM a FULL JOIN b USING (k) FULL JOIN c USING (k) WHERE NOT coalesce(a = b AND b = c AND na = 1 AND nb = 1 AND nc = 1, false)")
def _(spark, d):
    c = table(spark, d, "customer")
    return freeze.mapping_check(*(c.filter(F.col("c_custkey") % 3 == k) for k in range(3)), "c_nationkey", "c_mktsegment")


@query("positional_link", "SELECT a.s_suppkey, a.s_acctbal, b.i IS NOT NULL AND coalesce(abs(a.s_acctbal - b.s_acctbal) <= 1e-9, false) AS verified FROM supplier a LEFT JOIN (SELECT s_suppkey + s_suppkey % 2 AS i, s_acctbal FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey = 2) b ON a.s_suppkey - 1 = b.i")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    other = s.filter("s_suppkey % 2 = 1 or s_suppkey = 2").withColumn("i", F.col("s_suppkey") + F.col("s_suppkey") % 2)
    return freeze.positional_link(s, other, "s_suppkey", "i", ["s_acctbal"], 1e-9)


@query("dense_rows", SALES_SQL + ", k AS (SELECT n_name, p_type, round(avg(l_quantity), 5) AS v FROM sale GROUP BY ALL), g AS (SELECT n_name FROM k GROUP BY 1 HAVING count(*) >= 0.95 * (SELECT count(DISTINCT p_type) FROM k)) SELECT n_name, p_type, coalesce(v, 0) AS v FROM g CROSS JOIN (SELECT DISTINCT p_type FROM k) LEFT JOIN k USING (n_name, p_type)")
def _(spark, d):
    k = sales(spark, d).groupBy("n_name", "p_type").agg(r(F.avg("l_quantity"), 5).alias("v"))
    return freeze.dense_rows(k, "n_name", "p_type", "v").select("n_name", "p_type", "v")


@query("first_block", "WITH f AS (SELECT arg_min(user_id, event_id) AS u FROM events) SELECT event_type, row_number() OVER (ORDER BY min(event_id))::INT AS place FROM events, f WHERE user_id = u GROUP BY 1")
def _(spark, d):
    return freeze.first_block(table(spark, d, "events"), "event_id", "user_id", "event_type")


@query("weight_entropy", "SELECT label, axis, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM (SELECT label, axis, abs(w) / sum(abs(w)) OVER (PARTITION BY label, axis) AS p FROM (SELECT label, unnest(range(len(embedding)))::INT AS axis, unnest(embedding)::DOUBLE AS w FROM embeddings)) GROUP BY ALL")
def _(spark, d):
    """Entropy of each label's weights along every axis of the embeddings."""
    w = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("axis", "w")).withColumn("w", F.col("w").cast("double"))
    return rounded(freeze.entropy(w, ["label", "axis"], "w"))


@query("edge_bins", "WITH e AS (SELECT quantile_cont(p_retailprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM part) SELECT p_partkey, len(list_filter(e, lambda x: x < p_retailprice))::INT AS bin FROM part, e")
def _(spark, d):
    return freeze.edge_bins(table(spark, d, "part"), "p_retailprice", 10).select("p_partkey", "bin")


@query("semi_synthetic", "SELECT s_suppkey, round(sqrt(0.3) * (s_acctbal / 1000) + sqrt(0.7) * sqrt(-2 * ln(1 - " + UNIFORM.format("'gsu|' || s_suppkey") + ")) * cos(2 * pi() * " + UNIFORM.format("'gsv|' || s_suppkey") + "), 6) AS generated FROM supplier")
def _(spark, d):
    return rounded(freeze.generated(table(spark, d, "supplier"), "s_suppkey", F.col("s_acctbal") / 1000, 0.3, "gs").select("s_suppkey", "generated"))


@query("program_match", with_facts(GAMMA + ", c AS (SELECT a.context AS a, b.context AS b, round(corr(a.gamma, b.gamma), 9) AS r FROM gam a JOIN gam b USING (intervention, feature) WHERE a.replicate = 0 AND b.replicate = 1 GROUP BY ALL) SELECT a AS program, b AS match, round(r, 6) AS r FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b) = 1"))
def _(spark, d):
    return rounded(freeze.program_match(gamma(spark, d), "context", "replicate", ["intervention", "feature"], "gamma", 0, 1))


@query("pooled_r2", with_facts(PRED + ", f AS (SELECT feature, sum((value - pred) ** 2) AS sse, var_pop(value) * count(*) AS sst FROM p GROUP BY 1) SELECT round(1 - sum(sse) / sum(sst), 6) AS pooled, round(avg(1 - sse / sst), 6) AS mean, round(avg((1 - sse / sst > -0.5)::INT), 6) AS \"above_-0_5\", round(avg((1 - sse / sst > 0.0)::INT), 6) AS above_0_0 FROM f"))
def _(spark, d):
    return rounded(freeze.pooled_r2(predicted(spark, d), "feature", "value", "loo", [-0.5, 0.0]))


@query("coordinate_diagnostics", with_facts(PRED + ", f AS (SELECT feature, 1 - sum((value - pred) ** 2) / (var_pop(value) * count(*)) AS r2, avg((sign(value - 20) = sign(pred - 20))::INT) AS same_sign, var_pop(pred) / var_pop(value) AS variance_ratio, sum(value * value) AS energy FROM p GROUP BY 1) SELECT feature, round(r2, 5) AS r2, round(same_sign, 5) AS same_sign, round(variance_ratio, 5) AS variance_ratio, round(energy, 1) AS energy FROM f UNION ALL SELECT NULL, round(sum(r2 * energy) / sum(energy), 5), round(sum(same_sign * energy) / sum(energy), 5), round(sum(variance_ratio * energy) / sum(energy), 5), round(sum(energy), 1) FROM f"))
def _(spark, d):
    p = predicted(spark, d).withColumn("energy", F.col("value") * F.col("value")).withColumn("value", F.col("value") - 20).withColumn("loo", F.col("loo") - 20)
    return rounded(freeze.coordinates(p, "feature", "value", "loo", "energy"), "energy", digits=5).withColumn("energy", r("energy", 1))


@query("gate_classes", with_facts(PRED + ", s AS (SELECT context, sum(value * pred) / sum(value * value) AS alpha, sqrt(sum(pred * pred) / sum(value * value)) AS kappa, corr(value, pred) AS c FROM p GROUP BY 1), g AS (SELECT context, (kappa > 0.99)::INT + (alpha > 0.99)::INT AS amplitude, (c > 0.99)::INT + (c > 0.995)::INT AS relation FROM s) SELECT *, CASE WHEN amplitude >= 2 AND relation >= 2 THEN 'both' WHEN amplitude >= 2 THEN 'amplitude' WHEN relation >= 2 THEN 'relational' ELSE 'neither' END AS class FROM g"))
def _(spark, d):
    t, p = F.col("value"), F.col("loo")
    s = predicted(spark, d).groupBy("context").agg((F.sum(t * p) / F.sum(t * t)).alias("alpha"), F.sqrt(F.sum(p * p) / F.sum(t * t)).alias("kappa"), F.corr(t, p).alias("c"))
    return freeze.gate_classes(s, "context", [F.col("kappa") > 0.99, F.col("alpha") > 0.99], [F.col("c") > 0.99, F.col("c") > 0.995], 2)


@query("scaling_laws", """WITH p AS (SELECT c_mktsegment AS curve, k::DOUBLE AS x, round(avg(c_acctbal) FILTER (c_custkey % 10 < k), 4) AS y FROM customer, range(2, 10) t(k) GROUP BY ALL), rt AS (SELECT (i * 0.05)::DOUBLE AS rate FROM range(1, 41) t(i)),
a AS (SELECT curve, x, y, 'constant' AS law, 0.0::DOUBLE AS rate, 0.0::DOUBLE AS z FROM p UNION ALL SELECT curve, x, y, 'logarithm', 0.0, ln(x) FROM p UNION ALL SELECT curve, x, y, 'power', rate, x ** -rate FROM p, rt UNION ALL SELECT curve, x, y, 'exponential', rate, exp(-rate * x) FROM p, rt),
f AS (SELECT curve, law, rate, count(*) AS n, avg(z) AS mz, avg(y) AS my, var_pop(z) * count(*) AS szz, covar_pop(z, y) * count(*) AS szy FROM a GROUP BY ALL), e AS (SELECT a.curve, a.law, a.rate, a.x, n, y - my - CASE WHEN szz > 1e-12 THEN szy / szz ELSE 0 END * (z - mz) AS e, greatest(1 - (1.0 / n + CASE WHEN szz > 1e-12 THEN (z - mz) ** 2 / szz ELSE 0 END), 1e-9) AS h FROM a JOIN f USING (curve, law, rate)),
ss AS (SELECT curve, law, rate, n, greatest(sum(e * e), 1e-12) AS sse, CASE law WHEN 'constant' THEN 2 WHEN 'logarithm' THEN 3 ELSE 4 END AS k FROM e GROUP BY ALL),
o AS (SELECT curve, law, x, e / h AS o FROM e JOIN ss USING (curve, law, rate) QUALIFY row_number() OVER (PARTITION BY curve, law, x ORDER BY round(sse - e * e / h, 9), rate) = 1), lo AS (SELECT curve, law, sqrt(avg(o * o)) AS loo FROM o GROUP BY ALL),
s AS (SELECT * FROM ss JOIN lo USING (curve, law)), b AS (SELECT *, n * ln(sse / n) + 2 * k + 2.0 * k * (k + 1) / greatest(n - k - 1, 1) AS aicc FROM s QUALIFY row_number() OVER (PARTITION BY curve, law ORDER BY round(sse, 9), rate) = 1)
SELECT curve, law, round(rate, 2) AS rate, round(sse, 2) AS sse, round(loo, 3) AS loo, round(aicc, 3) AS aicc, row_number() OVER (PARTITION BY curve ORDER BY round(loo, 9), round(aicc, 9), law) = 1 AS chosen FROM b""")
def _(spark, d):
    from .registry import curves

    s = freeze.scaling_laws(curves(spark, d), "curve", "x", "y", [k * 0.05 for k in range(1, 41)])
    return s.select("curve", "law", r("rate", 2).alias("rate"), r("sse", 2).alias("sse"), r("loo", 3).alias("loo"), r("aicc", 3).alias("aicc"), "chosen")


# --- texts and arrays -------------------------------------------------------------------------------


@query("text_labels", r"SELECT p_partkey, CASE WHEN n = '' THEN '' ELSE n || 'd' END AS day, l || '_ABC' AS cell, CASE WHEN p_partkey % 3 = 0 THEN 'second' WHEN p_partkey % 3 = 1 THEN 'v' || p_partkey ELSE 'r1' END AS replicate, 'Pt' || p_partkey AS patient FROM (SELECT p_partkey, p_partkey::VARCHAR AS l, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE '' END AS n FROM part)")
def _(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    k = F.col("k")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(k, F.lit("-v7-x_rep2"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("s-V"), k, F.lit("-a"))).otherwise(k)
    return p.select("p_partkey", T.day_label(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("harvest day "), k)).otherwise(F.lit("no date"))).alias("day"), T.cell_id(F.concat(F.lit("MP-ABC-"), k)).alias("cell"), T.replicate_label(name, {"_rep2": "second"}).alias("replicate"), T.patient(F.concat(F.lit("Pt"), k, F.lit("_b"))).alias("patient"))


@query("title_patterns", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS line, CASE WHEN c_custkey % 3 < 2 THEN (c_custkey % 5)::VARCHAR END AS version FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    k = (F.col("c_custkey") % 5).cast("string")
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("line="), F.col("c_mktsegment"), F.lit(" v"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.col("c_mktsegment"), F.lit(" / "), k)).otherwise(F.lit("?"))
    return c.select("c_custkey", *(x.alias(n) for n, x in T.either_pattern(title, r"^line=(\w+) v(\d+)$", r"^(\w+) / (\d+)$", ["line", "version"]).items()))


@query("exploded_lists", "WITH x AS (SELECT DISTINCT c_nationkey, unnest([c_mktsegment, 'n' || c_nationkey]) AS item FROM customer) SELECT c_nationkey, item, count(*) OVER (PARTITION BY item) = 1 AS unambiguous FROM x")
def _(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.concat(F.col("c_mktsegment"), F.lit("; n"), F.col("c_nationkey").cast("string"), F.lit(";")).alias("packed"))
    return T.exploded(c, "c_nationkey", "packed")


@query("lenient_flags", "SELECT p_partkey, p_size % 2 <> 0 AS by_number, lower(p_type) IN ('x') OR p_size % 3 = 0 AS by_text, p_size > 25 AS by_flag FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    s = F.col("p_size")
    return p.select("p_partkey", T.lenient_bool(s % 2, "int").alias("by_number"), T.lenient_bool(F.when(s % 3 == 0, " Yes").otherwise("nope"), "string").alias("by_text"), T.lenient_bool(F.when(s > 25, True), "boolean").alias("by_flag"))


@query("array_functions", "SELECT n_nationkey, (n_regionkey = 1)::INT || ',' || (n_regionkey = 2)::INT AS hot, n_nationkey || ',' || n_regionkey || ',' || n_nationkey || ',' || n_regionkey AS tiled, '3,' || n_nationkey || ',' || n_regionkey AS rolled, n_nationkey + 1.5 AS total, '1,2,3,7,-1' AS padded FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").withColumnRenamed(T.column_of(table(spark, d, "nation"), "id", "N_NATIONKEY"), "n_nationkey")
    pair = F.array(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    packed = F.concat(F.col("n_nationkey").cast("string"), F.lit(";1.5;x"))
    return n.select("n_nationkey", text(T.one_hot(F.col("n_regionkey"), [1, 2])).alias("hot"), text(T.tile(pair, 2)).alias("tiled"), text(T.roll(F.concat(pair, F.array(F.lit(3))), 1)).alias("rolled"), F.aggregate(F.filter(T.floats(packed), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x).alias("total"), text(T.padded(T.ranges(F.lit("1-3,7")), 5)).alias("padded"))


@query("trend_audit", "WITH c AS (SELECT p_size % 6 AS k, p_retailprice AS v FROM part), m AS (SELECT k, median(v) AS m FROM c GROUP BY 1), rk AS (SELECT k, rank() OVER (ORDER BY k) AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS b FROM m), et AS (SELECT sum(n * (a - g) ** 2) / any_value(t) AS eta2 FROM (SELECT count(*) AS n, avg(v) AS a FROM c GROUP BY k), (SELECT avg(v) AS g, var_pop(v) * count(*) AS t FROM c)) SELECT round(corr(a, b), 6) AS trend, round(any_value(eta2), 6) AS eta2, CASE WHEN abs(corr(a, b)) >= 0.8 AND any_value(eta2) >= 0.06 THEN 'graded' WHEN any_value(eta2) >= 0.06 THEN 'different' ELSE 'flat' END AS verdict FROM rk, et")
def _(spark, d):
    return rounded(metrics.trend_audit(table(spark, d, "part").select((F.col("p_size") % 6).alias("k"), F.col("p_retailprice").alias("v")), "k", "v", 0.8, 0.06))
