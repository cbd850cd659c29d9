"""Queries of hierarchical draws, derangements, sets of axes, random controls, ceilings, programs, grids and episode choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classify, crossgram, decompose, design, families, freeze, inference, interaction, models, nulls, programs, sealed, subspace, tuning
from ..sources import facts
from ..sources.facts import table
from .deep import BASIS, DONOR, brand_basis, by_brand, donors, hash_fold, tuning_units, vectors
from .more import DRAWS, PAIRD, cross_scores, pair_distances
from .registry import ENERGY, GAMMA, gamma, query, r, rounded, with_facts

U = "(('0x' || substr(sha256({}), 1, 13))::BIGINT / 4503599627370496.0)"


def nested_sql(outer: str, inner: str, frm: str, seed: str, n: int) -> str:
    """nd(draw, o, i, times): outer units with replacement, then inner ones within each."""
    return f"""ox AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT {outer} AS o FROM {frm})),
ot AS (SELECT draw, ox.o, count(*) AS times FROM (SELECT draw, floor({U.format(f"'{seed}|' || draw || '|' || ox.k")} * ox.n)::INT AS k FROM ox, range({n}) t(draw)) p JOIN ox USING (k) GROUP BY ALL),
ix AS (SELECT o, i, row_number() OVER (PARTITION BY o ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY o) AS n FROM (SELECT DISTINCT {outer} AS o, {inner} AS i FROM {frm})),
pk AS (SELECT draw, o, floor({U.format(f"'{seed}|' || draw || '|' || o || '|' || rep || '|' || k")} * n)::INT AS k FROM ot JOIN ix USING (o), range(1, 1000) q(rep) WHERE rep <= times),
nd AS (SELECT draw, o, i, count(*) AS times FROM pk JOIN ix USING (o, k) GROUP BY ALL)"""


@query("nested_bootstrap", with_facts(", " + nested_sql("context", "intervention", "fact", "13", 20) + " SELECT draw::INT AS draw, o AS context, i AS intervention, times FROM nd"))
def _(spark, d):
    return inference.nested_draws(facts.facts(spark, d), "context", "intervention", 20, "13")


@query("hierarchical_spearman", "WITH " + nested_sql("p_brand", "p_partkey", "part", "hs", 5) + """, e AS (SELECT draw, p_size AS x, p_retailprice AS y FROM nd JOIN part ON p_partkey = i, range(1, 1000) t(k) WHERE k <= times),
k AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY x) + (count(*) OVER (PARTITION BY draw, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY draw ORDER BY y) + (count(*) OVER (PARTITION BY draw, y) - 1) / 2.0 AS b FROM e) SELECT draw::INT AS draw, round(corr(a, b), 5) AS spearman FROM k GROUP BY 1""")
def _(spark, d):
    """Brands drawn, then parts of each; ranks from counts of values."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    return rounded(nulls.spearman_draws(inference.nested_draws(p, "p_brand", "p_partkey", 5, "hs"), p, ["p_brand", "p_partkey"], "x", "y"), digits=5)


PAIR_FOLD = "(('0x' || substr(sha256('pg|' || {}), 1, 13))::BIGINT % 3)"


@query("pair_geometry_draws", with_facts(PAIRD + ", " + DRAWS.format(unit="a", frm="(SELECT a FROM dd UNION SELECT b FROM dd)", seed="pg", n=20) + ", w AS (SELECT p.draw, " + PAIR_FOLD.format("dd.a") + " AS fold, x, y, p.times * q.times AS w FROM dd JOIN dw p ON p.u = dd.a JOIN dw q ON q.u = dd.b AND q.draw = p.draw WHERE " + PAIR_FOLD.format("dd.a") + " = " + PAIR_FOLD.format("dd.b") + """),
e AS (SELECT draw, fold, x, y FROM w, range(1, 100) t(k) WHERE k <= w), k AS (SELECT draw, fold, rank() OVER (PARTITION BY draw, fold ORDER BY x) + (count(*) OVER (PARTITION BY draw, fold, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY draw, fold ORDER BY y) + (count(*) OVER (PARTITION BY draw, fold, y) - 1) / 2.0 AS b FROM e),
s AS (SELECT draw, fold, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS c FROM k GROUP BY ALL) SELECT draw::INT AS draw, round(avg(c), 5) AS geometry FROM s GROUP BY 1"""))
def _(spark, d):
    """Rank agreement of both replicates' distances over pairs of one fold, contexts drawn with replacement."""
    p = pair_distances(spark, d)
    units = p.select(F.col("a").alias("context")).unionByName(p.select(F.col("b").alias("context")))
    folded = p.withColumn("fold", hash_fold("a", "pg", 3)).filter(F.col("fold") == hash_fold("b", "pg", 3))
    return rounded(nulls.pair_geometry_draws(inference.unit_draws(units, "context", 20, "pg"), folded, "context", "x", "y"), digits=5)


@query("all_derangements", with_facts(GAMMA + """, sc AS (SELECT a.context AS q, b.context AS t, round(sum(a.gamma * b.gamma), 6) AS s FROM gam a JOIN gam b ON a.intervention = b.intervention AND a.feature = b.feature AND a.replicate = 0 AND b.replicate = 1 GROUP BY ALL),
u AS (SELECT list(DISTINCT q ORDER BY q) AS us FROM sc), x AS (SELECT unnest(us) AS v FROM u),
p AS (SELECT us, [a.v, b.v, c.v, e.v, f.v] AS o FROM u, x a, x b, x c, x e, x f WHERE len(us) = 5 AND len(list_distinct([a.v, b.v, c.v, e.v, f.v])) = 5 AND a.v <> us[1] AND b.v <> us[2] AND c.v <> us[3] AND e.v <> us[4] AND f.v <> us[5]),
m AS (SELECT row_number() OVER (ORDER BY o) - 1 AS shift, us, o FROM p), z AS (SELECT shift, unnest(us) AS q, unnest(o) AS t FROM m)
SELECT shift::INT AS shift, round(avg(s), 4) AS matched FROM z JOIN sc USING (q, t) GROUP BY 1""", "r_name"))
def _(spark, d):
    """Every derangement of five regions: their mean score against other regions' replicate."""
    g = gamma(spark, d, "r_name")
    a, b = (g.filter(F.col("replicate") == k).select("intervention", "feature", F.col("context").alias(n), F.col("gamma").alias(f"g{n}")) for k, n in ((0, "q"), (1, "t")))
    s = facts.stored(a.join(b, ["intervention", "feature"]).groupBy("q", "t").agg(r(F.sum(F.col("gq") * F.col("gt"))).alias("s")), "region-scores")
    return rounded(nulls.match_null(s, "q", "t", "s", nulls.derangements(s, "q", 99, "dr"), "shift"), digits=4)


@query("hash_derangements", with_facts(GAMMA + """, sc AS (SELECT a.context AS q, b.context AS t, round(sum(a.gamma * b.gamma), 6) AS s FROM gam a JOIN gam b ON a.intervention = b.intervention AND a.feature = b.feature AND a.replicate = 0 AND b.replicate = 1 GROUP BY ALL),
o AS (SELECT shift, q, row_number() OVER (PARTITION BY shift ORDER BY sha256('hd|' || shift || '|' || q), q) - 1 AS i, count(*) OVER (PARTITION BY shift) AS n FROM (SELECT DISTINCT q FROM sc), range(15) t(shift))
SELECT a.shift::INT AS shift, round(avg(s), 4) AS matched FROM o a JOIN o b ON a.shift = b.shift AND b.i = (a.i + 1) % a.n JOIN sc ON sc.q = a.q AND sc.t = b.q GROUP BY 1"""))
def _(spark, d):
    s = facts.stored(cross_scores(spark, d), "context-scores")
    return rounded(nulls.match_null(s, "q", "t", "s", nulls.derangements(s, "q", 15, "hd"), "shift"), digits=4)


# --- sets of axes and random controls -----------------------------------------------------------


@query("powerset", "WITH m AS (SELECT substr(p_brand, 1, 7) AS maker, count(*) AS n FROM part GROUP BY 1), a AS (SELECT list(maker ORDER BY maker) AS ms, list(n ORDER BY maker) AS ns, count(*) AS k FROM m) SELECT mask, len(list_filter(range(k), lambda i: (mask >> i) & 1 = 1))::INT AS members, list_sum(list_transform(list_filter(range(k), lambda i: (mask >> i) & 1 = 1), lambda i: ns[i + 1]))::BIGINT AS parts FROM a, range(1, 4096) t(mask) WHERE mask < (1 << k)")
def _(spark, d):
    """Every set of manufacturers and the parts that it has."""
    m = table(spark, d, "part").groupBy(F.substring("p_brand", 1, 7).alias("maker")).agg(F.count(F.lit(1)).alias("n"))
    k = m.count()
    held = m.agg(F.sort_array(F.collect_list(F.struct("maker", "n"))).alias("ms"))
    s = design.subsets(spark, k).join(F.broadcast(held))  # one row
    return s.select("mask", F.size("items").alias("members"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, i: a + F.get(F.col("ms"), i)["n"]).alias("parts"))


SUBSETS = GAMMA + ENERGY + ", " + BASIS + """, c AS (SELECT replicate, context, err.feature AS measure, axis, sum(gamma * weight) AS cs, sum(e * weight) AS ce FROM err JOIN b ON err.intervention = b.feature GROUP BY ALL),
x AS (SELECT p.axis, sum(p.cs * q.cs) AS s, sum(p.ce * q.ce) AS e FROM c p JOIN c q ON p.context = q.context AND p.measure = q.measure AND p.axis = q.axis AND p.replicate = 0 AND q.replicate = 1 GROUP BY 1),
fu AS (SELECT sum(s) AS s FROM en), l AS (SELECT list(axis ORDER BY axis) AS ax, list(s ORDER BY axis) AS ss, list(e ORDER BY axis) AS es, count(*) AS k FROM x),
t AS (SELECT mask, list_filter(range(k), lambda i: (mask >> i) & 1 = 1) AS i, ax, ss, es FROM l, range(1, 4096) t(mask) WHERE mask < (1 << k)),
w AS (SELECT mask, list_sum(list_transform(i, lambda j: ss[j + 1])) AS s, list_sum(list_transform(i, lambda j: es[j + 1])) AS e, array_to_string(list_transform(i, lambda j: ax[j + 1]), ',') AS axes FROM t)"""


@query("subset_fidelity", with_facts(SUBSETS + " SELECT mask, axes, round(w.s, 4) AS s, round(w.e, 4) AS e, CASE WHEN fu.s > 0 THEN round(w.s / fu.s, 5) END AS f, CASE WHEN w.s > 0 THEN round(1 - w.e / w.s, 4) END AS g, CASE WHEN fu.s > 0 THEN round((w.s - w.e) / fu.s, 5) END AS u FROM w, fu"))
def _(spark, d):
    """Fidelity, recoverability and use of every set of manufacturers' axes, from one energy an axis."""
    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    e = facts.stored(interaction.leave_one_out_mean(g, "replicate", "intervention", "feature").withColumn("err", F.col("value") - F.col("loo")), "subset-errors")
    named = lambda c: e.select("replicate", "context", F.col("feature").alias("measure"), F.col("intervention").alias("feature"), F.col(c).alias("value"))
    unit = ["replicate", "context", "measure"]
    basis = facts.stored(families.orthonormal(brand_basis(spark, d)), "brand-basis")
    score = families.coarse(named("value"), unit, basis).withColumnRenamed("score", "cs").join(families.coarse(named("err"), unit, basis).withColumnRenamed("score", "ce"), [*unit, "axis"])
    a, b = (score.filter(F.col("replicate") == k).select("context", "measure", "axis", F.col("cs").alias(f"s{k}"), F.col("ce").alias(f"e{k}")) for k in (0, 1))
    signal = facts.stored(a.join(b, ["context", "measure", "axis"]).groupBy("axis").agg(F.sum(F.col("s0") * F.col("s1")).alias("s"), F.sum(F.col("e0") * F.col("e1")).alias("e")), "axis-energies")
    full = interaction.energies(e, "value", "loo").agg(F.sum("s").alias("s"))
    out = families.subset_fidelity(signal, full)
    return out.select("mask", F.array_join("axes", ",").alias("axes"), r("s", 4).alias("s"), r("e", 4).alias("e"), r("f", 5).alias("f"), r("g", 4).alias("g"), r("u", 5).alias("u"))


@query("matched_sparsity", with_facts(GAMMA + ", " + BASIS + """, ui AS (SELECT draw, feature, row_number() OVER (PARTITION BY draw ORDER BY feature) AS i, row_number() OVER (PARTITION BY draw ORDER BY sha256('ms|' || draw || '|' || feature), feature) AS j FROM b, range(30) t(draw)),
pm AS (SELECT a.draw, a.feature AS f, z.feature AS o FROM ui a JOIN ui z ON a.draw = z.draw AND a.i = z.j), bs AS (SELECT draw, axis, o AS feature, weight FROM pm JOIN b ON b.feature = f UNION ALL SELECT -1, axis, feature, weight FROM b),
sc AS (SELECT draw, replicate, context, gam.feature AS measure, axis, sum(gamma * weight) AS s FROM gam JOIN bs ON bs.feature = gam.intervention GROUP BY ALL)
SELECT draw::INT AS draw, round(sum(s ** 2) / (SELECT sum(gamma ** 2) FROM gam), 6) AS share FROM sc GROUP BY 1"""))
def _(spark, d):
    """Energy along manufacturers' axes (draw -1) and along 30 bases whose brands are dealt anew."""
    bases = families.shuffled_bases(facts.stored(brand_basis(spark, d), "brand-basis"), 30, "ms")
    return rounded(families.shares_along(by_brand(spark, d), ["replicate", "context", "measure"], bases))


@query("random_bases")
def _(spark, d):
    """Energy along 20 random orthonormal bases of as many axes as there are manufacturers, beside the manufacturers' own."""
    basis = facts.stored(brand_basis(spark, d), "brand-basis")
    names = sorted(x[0] for x in basis.select("feature").collect())  # brands, an axis of the design
    made = decompose.random_bases(spark, names, basis.select("axis").distinct().count(), 20).select(F.col("draw").cast("int").alias("draw"), F.col("axis").cast("string").alias("axis"), "feature", "weight")
    every = made.unionByName(basis.select(F.lit(-1).alias("draw"), "axis", "feature", "weight"))
    return rounded(families.control_summary(families.shares_along(by_brand(spark, d), ["replicate", "context", "measure"], every)))


# --- ceilings and matching ----------------------------------------------------------------------------


@query("truth_ceiling", DONOR + """, sd AS (SELECT 'halves' AS kind, part, donor, side FROM (VALUES (0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 1), (1, 0, 0), (1, 2, 0), (1, 1, 1), (1, 3, 1), (2, 0, 0), (2, 3, 0), (2, 1, 1), (2, 2, 1)) h(part, donor, side) UNION ALL SELECT 'rest', a::INT, b::INT, (a <> b)::INT FROM range(4) p(a), range(4) q(b)),
m AS (SELECT kind, part, side, state, item, feature, avg(value) AS v FROM lv JOIN sd USING (donor) GROUP BY ALL),
g AS (SELECT kind, part, side, state, item, feature, v - avg(v) OVER (PARTITION BY kind, part, side, feature, state) - avg(v) OVER (PARTITION BY kind, part, side, feature, item) + avg(v) OVER (PARTITION BY kind, part, side, feature) AS g FROM m),
k AS (SELECT *, unnest(['all', CASE WHEN feature = 'quantity' THEN 'size' ELSE 'rates' END]) AS block FROM g)
SELECT a.kind, a.part, a.block, round(sum(a.g * b.g) / sqrt(sum(a.g ** 2) * sum(b.g ** 2)), 6) AS cosine FROM k a JOIN k b USING (kind, part, block, state, item, feature) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL""")
def _(spark, d):
    """Agreement of donors' halves and of each donor with the rest, over all measures and by block."""
    v = donors(spark, d)  # centring by unit and measure leaves interactions as they are
    dealt = facts.stored(crossgram.sides(v.select("donor").distinct()), "sides")
    return rounded(crossgram.truth_ceiling(v, dealt, {"quantity": "size", "discount": "rates", "tax": "rates"}))


@query("matching_summaries", with_facts(GAMMA + """, p AS (SELECT a.context, a.intervention, a.gamma AS x, b.gamma AS y FROM gam a JOIN gam b ON a.context = b.context AND a.intervention = b.intervention AND a.feature = b.feature AND a.replicate = 0 AND b.replicate = 1)
SELECT intervention, round(sum(x * y) / count(DISTINCT context), 5) AS variance, round(corr(x, y), 6) AS reliability FROM p GROUP BY 1"""))
def _(spark, d):
    g = gamma(spark, d).select("replicate", "context", F.col("feature").alias("measure"), "intervention", F.col("gamma").alias("value"))
    out = crossgram.matching_summaries(g, "intervention", ["context", "measure"])
    return out.select("intervention", r("variance", 5).alias("variance"), r("reliability").alias("reliability"))


# --- contrasts, programs, grids, episode choices --------------------------------------------------------


@query("paired_contrasts")
def _(spark, d):
    """Gain of the chosen dimension over all dimensions, both with the same drawn contexts."""
    units, folds = tuning_units(spark, d)
    errors = facts.stored(tuning.nested_errors(units, folds, [1.0, 10.0, 100.0, 1000.0], [1, 2, 4, 25]), "contrast-errors")
    both = []
    for name, cut in (("chosen", errors), ("full", errors.filter("k = 25"))):
        p = tuning.nested_predictions(units, folds, tuning.chosen(cut))
        sq = lambda c: F.sum((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
        both.append(p.groupBy("unit").agg(sq("population").alias("s"), sq("prediction").alias("e")).withColumn("model", F.lit(name)))
    e = facts.stored(both[0].unionByName(both[1]), "contrast-energies")
    diff = nulls.model_differences(inference.unit_draws(e, "unit", 200, "pc"), e, "unit", "model", "full")
    return rounded(inference.interval(diff, ["model"], "difference"), digits=4)


def price_shares(spark, d):
    """Each customer's spending by manufacturer, as shares: non-negative rows."""
    s = facts.sales(spark, d).groupBy("c_custkey", F.substring("p_brand", 1, 7).alias("maker")).agg(F.sum(F.col("l_extendedprice")).cast("double").alias("v"))
    total = s.groupBy("c_custkey").agg(F.sum("v").alias("t"))
    full = s.select("c_custkey").distinct().join(F.broadcast(s.select("maker").distinct()))  # makers are few
    s = full.join(s.join(total, "c_custkey").withColumn("v", F.col("v") / F.col("t")), ["c_custkey", "maker"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return facts.stored(subspace.packed_rows(s, ["c_custkey"], ["maker"], "v"), "price-shares")


@query("program_weights")
def _(spark, d):
    """Three programs of customers outside fold 0; all customers' weights on them and what is left, by fold."""
    rows = price_shares(spark, d)
    h = programs.fit_programs(rows.filter("c_custkey % 5 <> 0"), 3, passes=25)
    w = programs.transform(rows, h).withColumn("fold", (F.col("c_custkey") % 5).cast("int"))
    return rounded(w.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg("error").alias("error"), *(F.avg(F.get("weights", F.lit(k))).alias(f"w{k}") for k in range(3))), digits=3)


@query("program_stability")
def _(spark, d):
    return rounded(programs.stability(price_shares(spark, d), 2, [0, 1, 2], passes=25), digits=2)


@query("classifier_grid")
def _(spark, d):
    """Log loss of logistic and forest settings on documents' quality, by cross-validation over hash folds."""
    text = F.coalesce("text", F.lit(""))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / (F.length(text) + 1)
    named = {"chars": F.log1p(F.length(text).cast("double")), "digits": share("[0-9]"), "marks": share("[!-/:-@]"), "capitals": share("[A-Z]"), "breaks": share("\\n")}
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = both.select(*(c.alias(n) for n, c in named.items()), "quality", hash_fold("doc_id", "cg", 3).alias("fold"))
    return rounded(classify.chosen_settings(classify.grid_losses(rows, list(named), "quality", "fold")), digits=2)


def fold_grams(spark, d, seed):
    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    return facts.stored(sealed.by_fold(g, design.stride_folds(g, "intervention", seed)), "fold-grams")


@query("free_penalty")
def _(spark, d):
    """Inner-fold error of unconstrained weights by penalty, and each context's pick."""
    return rounded(sealed.nested_penalty(fold_grams(spark, d, "fp"), [0.01, 0.1, 1.0, 10.0], "free"), "ridge", digits=4)


@query("episode_choices")
def _(spark, d):
    return rounded(sealed.episode_choices(fold_grams(spark, d, "ec"), [0.1, 1.0, 10.0], [1, 4, 24], [0.0, 0.5, 0.9]), "ridge", "pull", digits=4)


@query("episode_errors")
def _(spark, d):
    """Every context from the first 2, 5 and 12 others of its own hash order: error against energy by size of support."""
    g = facts.stored(interaction.context_gram(interaction.gram(gamma(spark, d), "gamma")), "context-gram")
    names = g.select(F.col("ctx_a").alias("target")).distinct()
    other = names.join(names.withColumnRenamed("target", "source"), F.col("target") != F.col("source"))  # contexts of the design
    order = Window.partitionBy("target").orderBy(F.sha2(F.concat_ws("|", F.lit("ee"), "target", "source"), 256), "source")
    ladder = other.withColumn("place", F.row_number().over(order)).withColumn("m", F.explode(F.array(F.lit(2), F.lit(5), F.lit(12)))).filter("place <= m")
    episodes = facts.stored(ladder.select(F.concat_ws("|", "target", F.col("m").cast("string")).alias("episode"), "target", "source"), "episodes")
    return rounded(models.episode_errors(g, episodes, models.episode_weights(g, episodes, 0.1)), digits=4)


@query("module_ladder")
def _(spark, d):
    """Brands in modules at three correlation distances, and each module's first score over contexts and measures."""
    g = gamma(spark, d).filter("replicate = 0").select("context", "feature", F.col("intervention").alias("name"), F.col("gamma").alias("value"))
    out = decompose.module_ladder(facts.stored(g, "module-cells"), ["context", "feature"], [0.6, 0.9, 1.0])
    return out.groupBy("cut", "module").agg(F.max("names").alias("names"), r(F.max("explained"), 4).alias("explained"), r(F.sum(F.abs("score")), 3).alias("size"))


@query("synthetic_reliability")
def _(spark, d):
    """Realised correlation of two generated replicates of all vectors, at three target reliabilities."""
    rows = facts.stored(vectors(spark, d).select(F.col("vec_id").alias("id"), "x"), "synthetic-rows")
    parts = None
    for target in (0.3, 0.6, 0.9):
        z = freeze.semi_synthetic(rows, 5, 0.5, target, 3).select(F.explode(F.arrays_zip("a", "b")).alias("z"))
        one = z.agg(F.lit(target).alias("target"), F.round(F.corr("z.a", "z.b"), 3).alias("reliability"), F.count(F.lit(1)).alias("cells"))
        parts = one if parts is None else parts.unionByName(one)
    return parts
