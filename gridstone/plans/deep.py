"""Queries of distributed axes, nulls from products, nested choices, boosting, shrinkage, digests, and chunked sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boost, crossgram, families, interaction, leakage, nulls, profiled, ranks, shrinkage, subspace, tuning
from ..sources import arrays, facts, rowgroups
from ..sources.facts import shared_dir, table
from .registry import GAMMA, SALES_SQL, energy, gamma, query, r, rounded, with_facts

FOLD = "(('0x' || substr(sha256('{seed}|' || {unit}), 1, 13))::BIGINT % {n})::INT"


def hash_fold(unit: str, seed: str, n: int):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(unit).cast("string")), 256), 1, 13), 16, 10).cast("bigint")
    return (h % n).cast("int")


def filled(df: DataFrame, unit: list[str], names: list[str], value: str) -> DataFrame:
    """unit, names, value over the product of both axes of the design; 0 where there is no cell."""
    full = df.select(*unit).distinct().join(F.broadcast(df.select(*names).distinct()))
    return full.join(df.select(*unit, *names, value), [*unit, *names], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


# --- axes ------------------------------------------------------------------------------------


def vectors(spark, d):
    """Embeddings as rows; vectors that are null or hold null or non-finite components are left out."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).filter(F.col("x").isNotNull())
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(fine).withColumn("fold", (F.col("vec_id") % 5).cast("int"))


@query("randomized_pca")
def _(spark, d):
    """The first four axes of all vectors outside fold 0, and every vector's scores on them."""
    rows = vectors(spark, d)
    axes = subspace.fit_axes(rows.filter("fold <> 0"), 4, oversample=28, passes=12)
    return subspace.project(rows, axes).select("vec_id", "fold", F.posexplode("scores").alias("axis", "score")).withColumn("score", r("score", 4))


@query("held_out_fidelity")
def _(spark, d):
    rows = vectors(spark, d)
    axes = subspace.fit_axes(rows.filter("fold <> 0"), 8, oversample=24, passes=12)
    return rounded(subspace.fidelity(rows, axes, ["fold"]), digits=4)


@query("context_axes")
def _(spark, d):
    """Axes of the contexts' replicate 0; both replicates on them."""
    g = filled(gamma(spark, d), ["replicate", "context"], ["intervention", "feature"], "gamma")
    rows = facts.stored(subspace.packed_rows(g, ["replicate", "context"], ["intervention", "feature"], "gamma"), "context-rows")
    axes = subspace.fit_axes(rows.filter("replicate = 0"), 3)
    return subspace.project(rows, axes).select("replicate", "context", F.posexplode("scores").alias("axis", "score")).withColumn("score", r("score", 4))


BASIS = "b AS (SELECT substr(p_brand, 1, 7) AS axis, p_brand AS feature, 1 / sqrt(count(*) OVER (PARTITION BY substr(p_brand, 1, 7))) AS weight FROM (SELECT DISTINCT p_brand FROM part))"


def brand_basis(spark, d):
    """An axis a manufacturer: the brands' equal weights, orthonormal as no brand is in two."""
    b = table(spark, d, "part").select("p_brand").distinct().select(F.substring("p_brand", 1, 7).alias("axis"), F.col("p_brand").alias("feature"))
    return b.withColumn("weight", 1 / F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("axis")).cast("double")))


def by_brand(spark, d):
    """Gamma with brands as features: unit (replicate, context, measure)."""
    return gamma(spark, d).select("replicate", "context", F.col("feature").alias("measure"), F.col("intervention").alias("feature"), F.col("gamma").alias("value"))


@query("energy_split", with_facts(GAMMA + ", " + BASIS + """, c AS (SELECT replicate, context, gam.feature AS measure, axis, sum(gamma * weight) AS score FROM gam JOIN b ON gam.intervention = b.feature GROUP BY ALL),
a AS (SELECT g.replicate, g.context, g.feature AS measure, g.gamma, c.score * b.weight AS along FROM gam g JOIN b ON g.intervention = b.feature JOIN c ON c.replicate = g.replicate AND c.context = g.context AND c.measure = g.feature AND c.axis = b.axis)
SELECT context, measure, round(sum(gamma ** 2), 5) AS energy, round(sum(along ** 2), 5) AS along, round(sum((gamma - along) ** 2), 5) AS beside, round(sum(along ** 2) / sum(gamma ** 2), 6) AS share FROM a GROUP BY ALL"""))
def _(spark, d):
    e = families.energy_split(by_brand(spark, d), ["replicate", "context", "measure"], families.orthonormal(brand_basis(spark, d)), ["context", "measure"])
    return e.select("context", "measure", *(r(c, 5).alias(c) for c in ("energy", "along", "beside")), r("share").alias("share"))


@query("shared_axis_removal")
def _(spark, d):
    g = facts.stored(filled(by_brand(spark, d), ["replicate", "context", "measure"], ["feature"], "value"), "brand-gamma")
    unit = ["replicate", "context", "measure"]
    left = families.shared_axis_removal(g, unit, g.filter("replicate = 0").select(*unit).distinct(), [0, 1, 2])
    return rounded(left.groupBy("rank", "replicate", "measure").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.sum(F.col("residual") * F.col("residual")).alias("residual")), digits=4)


@query("oracle_residual")
def _(spark, d):
    g = interaction.context_gram(interaction.gram(gamma(spark, d), "gamma"))
    return rounded(families.oracle_residual(g), digits=5)


# --- nulls from products -----------------------------------------------------------------------

DONOR = SALES_SQL + """, v AS (SELECT l_orderkey % 4 AS donor, l_returnflag AS state, p_brand AS item, avg(l_quantity) AS quantity, avg(l_discount * 100) AS discount, avg(l_tax * 100) AS tax FROM sale GROUP BY ALL),
lv AS (SELECT donor::INT AS donor, state, item, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([quantity, discount, tax]) AS value FROM v),
cv AS (SELECT donor, state, item, feature, value - avg(value) OVER (PARTITION BY donor, state, feature) AS value FROM lv)"""


def donors(spark, d):
    s = facts.sales(spark, d).groupBy((F.col("l_orderkey") % 4).cast("int").alias("donor"), F.col("l_returnflag").alias("state"), F.col("p_brand").alias("item"))
    v = s.agg(F.avg("l_quantity").alias("quantity"), F.avg(F.col("l_discount") * 100).alias("discount"), F.avg(F.col("l_tax") * 100).alias("tax"))
    long = facts.stored(v.unpivot(["donor", "state", "item"], ["quantity", "discount", "tax"], "feature", "value"), "donors")
    return facts.stored(crossgram.centred(long), "donors-centred")


@query("crossgram_null", DONOR + """, u AS (SELECT DISTINCT donor, state, item FROM cv),
ui AS (SELECT draw, donor, state, item, row_number() OVER (PARTITION BY draw, donor, state ORDER BY item) AS i, row_number() OVER (PARTITION BY draw, donor, state ORDER BY sha256('cg|' || draw || '|' || item), item) AS j FROM u, range(20) t(draw)),
pm AS (SELECT a.draw, a.donor, a.state, a.item AS place, b.item FROM ui a JOIN ui b ON a.draw = b.draw AND a.donor = b.donor AND a.state = b.state AND a.i = b.j UNION ALL SELECT -1, donor, state, item, item FROM u),
sh AS (SELECT draw, donor, state, place, feature, value FROM pm JOIN cv USING (donor, state, item)),
pt AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 1), (1, 0, 0), (1, 2, 0), (1, 1, 1), (1, 3, 1), (2, 0, 0), (2, 3, 0), (2, 1, 1), (2, 2, 1)) p(partition, donor, side)),
ct AS (SELECT a.state AS state_a, b.state AS state_b FROM (SELECT DISTINCT state FROM cv) a, (SELECT DISTINCT state FROM cv) b WHERE a.state < b.state),
df AS (SELECT draw, partition, side, state_a, state_b, place, feature, sum(CASE WHEN state = state_a THEN value WHEN state = state_b THEN -value END) / 2 AS x FROM sh JOIN pt USING (donor) JOIN ct ON state IN (state_a, state_b) GROUP BY ALL)
SELECT a.draw::INT AS draw, a.partition, a.state_a, a.state_b, round(sum(a.x * b.x) / (SELECT count(DISTINCT item) * count(DISTINCT feature) FROM cv), 6) AS statistic FROM df a JOIN df b USING (draw, partition, state_a, state_b, place, feature) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL""")
def _(spark, d):
    """donors' halves over states, all items: observed (draw -1) and 20 draws, from products alone."""
    v = donors(spark, d)
    plan = facts.stored(crossgram.term_plan(v.select("donor", "state").distinct()), "terms")
    grams = facts.stored(crossgram.cross_grams(v, plan), "cross-grams")
    size = v.agg((F.count_distinct("item") * F.count_distinct("feature")).alias("n")).first().n
    return rounded(crossgram.null_statistics(grams, plan, crossgram.unit_permutations(v, 20, "cg"), size))


@query("residual_null", with_facts(GAMMA + """, rs AS (SELECT replicate, context, intervention, feature, gamma - (sum(gamma) OVER w - gamma) / (count(*) OVER w - 1) AS e FROM gam WINDOW w AS (PARTITION BY replicate, intervention, feature)),
k AS (SELECT DISTINCT intervention, """ + FOLD.format(seed="rn", unit="intervention", n=5) + """ AS fold FROM gam),
m AS (SELECT ka.fold, a.intervention AS p, b.intervention AS q, sum(a.e * b.e) AS x FROM rs a JOIN k ka ON ka.intervention = a.intervention JOIN rs b ON a.replicate = 0 AND b.replicate = 1 AND a.context = b.context AND a.feature = b.feature JOIN k kb ON kb.intervention = b.intervention AND ka.fold = kb.fold GROUP BY ALL),
ui AS (SELECT draw, fold, intervention AS u, row_number() OVER (PARTITION BY draw, fold ORDER BY intervention) AS i, row_number() OVER (PARTITION BY draw, fold ORDER BY sha256('rn|' || draw || '|' || intervention), intervention) AS j FROM k, range(50) t(draw)),
pm AS (SELECT a.draw, a.fold, a.u AS p, b.u AS q FROM ui a JOIN ui b ON a.draw = b.draw AND a.fold = b.fold AND a.i = b.j UNION ALL SELECT -1, fold, intervention, intervention FROM k)
SELECT draw::INT AS draw, round(sum(x), 4) AS energy FROM pm JOIN m USING (fold, p, q) GROUP BY 1"""))
def _(spark, d):
    """Cross-replicate energy of what is left at full support, interventions matched to others of their fold; draw -1 is as observed."""
    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    e = interaction.leave_one_out_mean(g, "replicate", "intervention", "feature").withColumn("e", F.col("value") - F.col("loo"))
    fold = hash_fold("intervention", "rn", 5)
    m = facts.stored(nulls.residual_products(e, "e", fold), "residual-products")
    return rounded(nulls.residual_null(m, 50, "rn"), digits=4)


# --- nested choices and refits ------------------------------------------------------------------


def tuning_units(spark, d):
    """unit (a context), x: the first replicate's discount, price and tax gammas of every brand; y: the second one's quantities. And folds by hash."""
    g = facts.stored(filled(gamma(spark, d), ["replicate", "context"], ["intervention", "feature"], "gamma"), "tuning-gamma")
    x = subspace.packed_rows(g.filter("replicate = 0 and feature <> 'quantity'"), ["context"], ["intervention", "feature"], "gamma")
    y = subspace.packed_rows(g.filter("replicate = 1 and feature = 'quantity'"), ["context"], ["intervention"], "gamma").withColumnRenamed("x", "y")
    units = x.join(y, "context").withColumnRenamed("context", "unit")
    folds = units.select("unit").withColumn("fold", hash_fold("unit", "nt", 4))
    return units, folds


ALPHAS, DIMS, WIDTHS = [0.1, 1.0, 10.0, 100.0, 1000.0], [1, 2, 4, 8], [0.5, 1.0, 2.0]


@query("nested_choices")
def _(spark, d):
    """Inner error of every dimension, penalty and width by outer fold, and the choice."""
    units, folds = tuning_units(spark, d)
    e = facts.stored(tuning.nested_errors(units, folds, ALPHAS, DIMS, WIDTHS), "nested-errors")
    pick = tuning.chosen(e).select("outer", F.col("k").alias("__k"), F.col("alpha").alias("__a"), F.col("width").alias("__w"))
    same = (F.col("k") == F.col("__k")) & (F.col("alpha") == F.col("__a")) & (F.col("width") == F.col("__w"))
    return e.join(pick, "outer").select("outer", "k", "alpha", "width", r("error", 4).alias("error"), "n", same.alias("picked"))


@query("nested_predictions")
def _(spark, d):
    units, folds = tuning_units(spark, d)
    picks = facts.stored(tuning.chosen(tuning.nested_errors(units, folds, ALPHAS, DIMS, WIDTHS)), "nested-picks")
    return rounded(tuning.nested_predictions(units, folds, picks), "alpha", "width", digits=4)


@query("variance_captured")
def _(spark, d):
    units, folds = tuning_units(spark, d)
    return rounded(tuning.variance_captured(units, folds, DIMS), digits=5)


@query("refit_nulls")
def _(spark, d):
    units, folds = tuning_units(spark, d)
    return rounded(tuning.gain_null(tuning.refit_nulls(units, folds, 100.0, 60)), digits=5)


@query("family_errors")
def _(spark, d):
    """Inner error of ridge on each family of representations of the contexts' prices by brand."""
    g = facts.stored(filled(by_brand(spark, d), ["replicate", "context", "measure"], ["feature"], "value"), "family-gamma")
    x = g.filter("replicate = 0 and measure = 'price'").select("context", "feature", "value")
    y = subspace.packed_rows(g.filter("replicate = 1 and measure = 'price'"), ["context"], ["feature"], "value").withColumnRenamed("x", "y")
    folds = y.select(F.col("context").alias("unit")).withColumn("fold", hash_fold("unit", "fe", 4))
    basis = facts.stored(brand_basis(spark, d), "brand-basis")
    parts = []
    for family, dims in (("full", 0), ("pca", 3), ("span", 0), ("coarse_plus_residual", 2), ("residual_only", 2)):
        for fold in range(4):  # axes are fitted without the outer fold
            train = folds.filter(F.col("fold") != fold).select(F.col("unit").alias("context"))
            rep = families.representation(x, ["context"], train, basis, family, dims)
            units = rep.join(y, "context").withColumnRenamed("context", "unit")
            e = tuning.nested_errors(units, folds, [1.0, 100.0], [25]).filter(F.col("outer") == fold)
            parts.append(e.select(F.lit(family).alias("family"), F.lit(dims).alias("dims"), "outer", "alpha", "error", "n"))
    return rounded(reduce(DataFrame.unionByName, parts), "alpha", digits=3)


@query("profiled_completion")
def _(spark, d):
    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", "value")
    folds = g.select("context", "intervention").distinct().withColumn("fold", hash_fold("intervention", "pc", 3))
    folds = folds.withColumn("fold", ((F.col("fold") + F.ascii(F.substring("context", -1, 1))) % 3).cast("int"))
    out = profiled.profiled_completion(g, folds, 2, 1e-3)
    e = lambda c: F.sum((F.col("value") - F.col(c)) * (F.col("value") - F.col(c)))
    return rounded(out.groupBy("replicate", "fold", "feature").agg(F.count(F.lit(1)).alias("cells"), e("additive").alias("additive_error"), e("prediction").alias("error"), F.bool_and("converged").alias("converged")), digits=2)


# --- boosting and shrinkage ----------------------------------------------------------------------

@query("boosted_regression")
def _(spark, d):
    """Error of predicting documents' quality labels from counts of their characters, after 1, 5 and 10 trees fitted on four documents of five."""
    text = F.coalesce("text", F.lit(""))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / (F.length(text) + 1)
    named = {"chars": F.length(text).cast("double"), "spaces": share("[ ]"), "breaks": share("\n"), "digits": share("[0-9]"), "marks": share("[!-/:-@]"), "capitals": share("[A-Z]")}
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = facts.stored(both.select(*(c.alias(n) for n, c in named.items()), F.col("quality").cast("double").alias("y"), (F.col("doc_id") % 5 == 0).alias("held")), "boost-rows")
    model = boost.fit(rows.filter("not held"), list(named), "y", 10, depth=3, rate=0.3)
    out = rows
    for n in (1, 5, 10):
        out = boost.predict(out, (model[0], model[1][:n], model[2]), f"p{n}")
    mse = lambda n: F.avg((F.col("y") - F.col(f"p{n}")) * (F.col("y") - F.col(f"p{n}")))
    return rounded(out.groupBy("held").agg(F.count(F.lit(1)).alias("rows"), F.var_pop("y").alias("variance"), *(mse(n).alias(f"mse_{n}") for n in (1, 5, 10))), digits=4)


LONG = """x AS (SELECT l_returnflag AS "group", l_orderkey || '-' || l_linenumber AS row, unnest(['discount', 'price', 'quantity', 'tax']) AS name, unnest([l_discount * 100, l_extendedprice / 1000, l_quantity::DOUBLE, l_tax * 100]) AS value FROM lineitem)"""


@query("shrunk_covariance", "WITH " + LONG + """, c AS (SELECT "group", row, name, value - avg(value) OVER (PARTITION BY "group", name) AS v FROM x), n AS (SELECT "group", count(DISTINCT row) AS n FROM x GROUP BY 1),
s AS (SELECT a."group", a.name AS a, b.name AS b, sum(a.v * b.v) / any_value(n) AS cov FROM c a JOIN c b ON a."group" = b."group" AND a.row = b.row JOIN n ON n."group" = a."group" GROUP BY ALL),
q AS (SELECT "group", sum(q * q) AS fourth FROM (SELECT "group", row, sum(v * v) AS q FROM c GROUP BY ALL) GROUP BY 1),
t AS (SELECT "group", sum(cov ** 2) AS ss, sum(cov) FILTER (a = b) / count(*) FILTER (a = b) AS mu, count(*) FILTER (a = b) AS p FROM s GROUP BY 1),
w AS (SELECT "group", mu, least((fourth / n - ss) / n, ss - p * mu ** 2) / (ss - p * mu ** 2) AS w FROM t JOIN q USING ("group") JOIN n USING ("group"))
SELECT "group", a, b, round((1 - w) * cov + CASE WHEN a = b THEN w * mu ELSE 0 END, 5) AS cov, round(w, 8) AS shrinkage FROM s JOIN w USING ("group")""")
def _(spark, d):
    line = table(spark, d, "lineitem")
    row = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    wide = line.select(F.col("l_returnflag").alias("group"), row.alias("row"), (F.col("l_discount") * 100).alias("discount"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_tax") * 100).alias("tax"))
    out = shrinkage.shrunk(wide.unpivot(["group", "row"], ["discount", "price", "quantity", "tax"], "name", "value"))
    return out.select("group", "a", "b", r("cov", 5).alias("cov"), r("shrinkage", 8).alias("shrinkage"))


@query("context_proximities")
def _(spark, d):
    """Proximities of nations in the mean gammas of manufacturers; the covariance of manufacturers over nations is shrunk."""
    g = gamma(spark, d).filter("replicate = 0").groupBy(F.col("feature").alias("group"), F.col("context").alias("point"), F.substring("intervention", 1, 7).alias("name")).agg(F.avg("gamma").alias("value"))
    g = facts.stored(g, "points")
    inverse = shrinkage.precision(shrinkage.shrunk(g.withColumnRenamed("point", "row")))
    return rounded(shrinkage.proximities(g, inverse), digits=4)


@query("transfer_utility", with_facts(""", b AS (SELECT context, feature, intervention, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS z FROM fact WHERE replicate = 0 WINDOW w AS (PARTITION BY feature, intervention))
SELECT t.feature AS program, s.context AS source, t.context AS target, round(avg((t.value - s.value) ** 2), 5) AS mse, round(avg((t.value - z) ** 2), 5) AS base_mse, round(avg((t.value - z) ** 2) - avg((t.value - s.value) ** 2), 5) AS mse_utility, round(corr(t.value, s.value), 5) AS pearson, round(corr(t.value, z), 5) AS base_pearson, round(corr(t.value, s.value) - corr(t.value, z), 5) AS pearson_utility
FROM fact t JOIN b ON b.context = t.context AND b.feature = t.feature AND b.intervention = t.intervention JOIN fact s ON s.feature = t.feature AND s.intervention = t.intervention AND s.context <> t.context AND s.replicate = 0 WHERE t.replicate = 0 GROUP BY ALL""", "r_name"))
def _(spark, d):
    f = facts.facts(spark, d, "r_name").filter("replicate = 0")
    loo = interaction.leave_one_out_mean(f, "replicate", "intervention", "feature")
    scores = f.select("context", F.col("feature").alias("program"), "intervention", F.col("value").alias("score"))
    base = loo.select(F.col("feature").alias("program"), F.col("context").alias("target"), "intervention", F.col("loo").alias("score"))
    return rounded(shrinkage.transfer_utility(scores, base), digits=5)


# --- digests and replay -----------------------------------------------------------------------------

CELLS_TEXT = "'=' || context || '|=' || intervention || '|=' || feature || '|=' || replicate"


@query("training_digests", with_facts(", k AS (SELECT DISTINCT context, " + FOLD.format(seed="td", unit="context", n=3) + """ AS fold FROM fact), o AS (SELECT range::INT AS outer_fold FROM range(3)),
t AS (SELECT outer_fold, sha256(""" + CELLS_TEXT + """) AS h FROM fact JOIN k USING (context) JOIN o ON outer_fold <> fold WHERE outer_fold IN (SELECT fold FROM k))
SELECT outer_fold AS "outer", 'keys' AS object, count(*) AS rows, sum(('0x' || substr(h, 1, 13))::BIGINT)::HUGEINT::VARCHAR || '-' || sum(('0x' || substr(h, 14, 13))::BIGINT)::HUGEINT::VARCHAR AS digest FROM t GROUP BY ALL"""))
def _(spark, d):
    """What each fold may see of the fact's keys, as order-free digests."""
    f = facts.facts(spark, d)
    folds = f.select("context").distinct().withColumn("fold", hash_fold("context", "td", 3))
    return leakage.training_digests(f, folds, "context", {"keys": ["context", "intervention", "feature", "replicate"]})


@query("prediction_replay", with_facts(""", k AS (SELECT a.replicate, a.context, a.intervention, a.feature, avg(b.value) AS x FROM fact a JOIN fact b USING (replicate, intervention, feature) WHERE a.context <> b.context GROUP BY ALL),
o AS (SELECT replicate, context, intervention, feature, (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0) AS y FROM fact WINDOW w AS (PARTITION BY replicate, intervention, feature)),
j AS (SELECT x, y, o.context AS co FROM fact LEFT JOIN k USING (replicate, context, intervention, feature) LEFT JOIN o USING (replicate, context, intervention, feature)),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT replicate, context, intervention, feature FROM fact)) AS d FROM fact)
SELECT 'stored keys are unique' AS "check", (n - d)::DOUBLE AS detail, n = d AS passed FROM n UNION ALL SELECT 'again keys are unique', (n - d)::DOUBLE, n = d FROM n
UNION ALL SELECT 'keys on both sides', count(*) FILTER (co IS NULL)::DOUBLE, count(*) FILTER (co IS NULL) = 0 FROM j UNION ALL SELECT 'values agree', round(coalesce(max(abs(x - y)), 0), 6), coalesce(max(abs(x - y)), 0) <= 1e-9 AND count(*) FILTER ((x IS NULL) <> (y IS NULL)) = 0 FROM j"""))
def _(spark, d):
    """Strict leave-one-out predictions, stored by one plan and replayed by another (sum less own value), to nine digits."""
    f = facts.facts(spark, d)
    keys = ["replicate", "context", "intervention", "feature"]
    kept = facts.stored(interaction.strict_leave_one_out_mean(f).select(*keys, "loo"), "predictions")
    again = interaction.leave_one_out_mean(f, "replicate", "intervention", "feature").select(*keys, "loo")
    return leakage.replay(kept, again, keys, "loo", 1e-9).withColumn("detail", r("detail"))


# --- ranks over whole tables ---------------------------------------------------------------------------


@query("exact_quantiles", "SELECT l_returnflag AS flag, unnest([0.05, 0.5, 0.95]) AS point, round(unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])), 4) AS q FROM lineitem GROUP BY 1")
def _(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"))
    return rounded(ranks.quantiles(line, ["flag"], "x", [0.05, 0.5, 0.95]), digits=4)


# --- chunked sources -------------------------------------------------------------------------------------


@query("row_group_scan", "SELECT l_returnflag AS flag, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _(spark, d):
    """Line items written by return flag; the scan opens the row groups of one of them."""
    path = f"{shared_dir(spark)}/gridstone/by-flag-{facts.token()}"
    facts.drop_later(spark, path)
    line = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.col("l_returnflag").alias("flag"))
    line.write.partitionBy("flag").option("parquet.block.size", str(1 << 20)).parquet(path)  # a task deals out its own split; no flag meets in one task
    found = rowgroups.row_groups(spark, path, ["l_returnflag", "l_quantity"], where=[("l_returnflag", "=", "R")])
    return found.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("rows"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query("zarr_round_trip", with_facts(""", a AS (SELECT context, dense_rank() OVER (ORDER BY context) - 1 AS i0, dense_rank() OVER (ORDER BY intervention) - 1 AS i1, dense_rank() OVER (ORDER BY feature) - 1 AS i2, value FROM fact WHERE replicate = 0)
SELECT i0, i1, i2, round(value, 6) AS value FROM a WHERE i0 IN (1, 3) AND i2 >= 2"""))
def _(spark, d):
    """The first replicate as an array of contexts by interventions by features, written in chunks; two contexts and the last features read back."""
    f = facts.facts(spark, d).filter("replicate = 0")
    axes = [ranks.numbered(f.select(c).distinct(), F.col(c).asc()).withColumn(f"i{k}", F.col("place") - 1).drop("place") for k, c in enumerate(("context", "intervention", "feature"))]
    shape = tuple(a.count() for a in axes)
    cells = f
    for a, c in zip(axes, ("context", "intervention", "feature")):
        cells = cells.join(F.broadcast(a), c)  # axes of the design
    path = f"{shared_dir(spark)}/gridstone/zarr-{facts.token()}"
    arrays.save_zarr(cells.select("i0", "i1", "i2", "value"), path, shape, (4, 10, 2))
    facts.drop_later(spark, path)
    got = arrays.chunked_array(spark, path, select={0: [1, 3], 2: range(2, shape[2])}).filter(~F.isnan("value"))
    return got.withColumn("value", r("value"))
