"""Registry of the engine's queries over the star schema, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import cohort, decompose, design, inference, interaction, metrics, models, ranks, signal
from ..sources.facts import fact_sql, facts, measures, once, sales, table
from ..streaming.events import windowed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def with_facts(body: str, context: str = "n_name") -> str:
    return f"WITH {fact_sql(context)}{body}"


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, other columns as they are."""
    return df.select(*(r(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


# --- interaction algebra -----------------------------------------------------------------

GAMMA = """,
gam AS (SELECT *, value - avg(value) OVER (PARTITION BY replicate, feature, context) - avg(value) OVER (PARTITION BY replicate, feature, intervention) + avg(value) OVER (PARTITION BY replicate, feature) AS gamma FROM fact)"""
ENERGY = """,
err AS (SELECT *, gamma - loo AS e FROM (SELECT *, (sum(gamma) OVER (PARTITION BY replicate, intervention, feature) - gamma) / (count(*) OVER (PARTITION BY replicate, intervention, feature) - 1) AS loo FROM gam)),
en AS (SELECT a.context, a.intervention, sum(a.gamma * b.gamma) AS s, sum(a.e * b.e) AS e FROM err a JOIN err b ON a.context = b.context AND a.intervention = b.intervention AND a.feature = b.feature AND a.replicate = 0 AND b.replicate = 1 GROUP BY ALL)"""


def gamma(spark, d, context="n_name"):
    """The centred fact, written once as the cells are: plans with many branches start from it."""
    return once(spark, d, f"gamma-{context}", lambda: interaction.two_way(facts(spark, d, context)))


def energy(spark, d):
    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    g = interaction.leave_one_out_mean(g, "replicate", "intervention", "feature")
    return interaction.energies(g, "value", "loo")


@query("interaction_energy", with_facts(GAMMA + """
SELECT a.context, round(sum(a.gamma * b.gamma), 6) AS s, count(*) AS cells FROM gam a JOIN gam b ON a.context = b.context AND a.intervention = b.intervention AND a.feature = b.feature AND a.replicate = 0 AND b.replicate = 1 GROUP BY 1""", "r_name"))
def _(spark, d):
    x = interaction.cross_replicate(gamma(spark, d, "r_name"), "gamma")
    return x.groupBy("context").agg(r(F.sum(F.col("gamma0") * F.col("gamma1"))).alias("s"), F.count(F.lit(1)).alias("cells"))


@query("two_way_interaction", with_facts(GAMMA + " SELECT replicate, context, intervention, feature, round(gamma, 6) AS gamma FROM gam"))
def _(spark, d):
    return rounded(gamma(spark, d).select("replicate", "context", "intervention", "feature", "gamma"))


@query("context_effect_removed", with_facts(" SELECT replicate, context, intervention, feature, round(value - avg(value) OVER (PARTITION BY replicate, feature, context), 6) AS residual FROM fact"))
def _(spark, d):
    return rounded(interaction.context_effect_removed(facts(spark, d)).select("replicate", "context", "intervention", "feature", "residual"))


@query("three_way_components", """WITH c AS (SELECT r_name AS a, l_returnflag AS b, p_brand AS c, avg(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
m AS (SELECT *, avg(v) OVER () AS g, avg(v) OVER (PARTITION BY a) AS ma, avg(v) OVER (PARTITION BY b) AS mb, avg(v) OVER (PARTITION BY c) AS mc, avg(v) OVER (PARTITION BY a, b) AS mab, avg(v) OVER (PARTITION BY a, c) AS mac, avg(v) OVER (PARTITION BY b, c) AS mbc FROM c)
SELECT a, b, c, round(mab - ma - mb + g, 6) AS ab, round(mac - ma - mc + g, 6) AS ac, round(mbc - mb - mc + g, 6) AS bc, round(v - mab - mac - mbc + ma + mb + mc - g, 6) AS abc FROM m""")
def _(spark, d):
    c = sales(spark, d).groupBy(F.col("r_name").alias("a"), F.col("l_returnflag").alias("b"), F.col("p_brand").alias("c")).agg(F.avg("l_quantity").alias("v"))
    return rounded(interaction.three_way(c, "a", "b", "c", "v", []).select("a", "b", "c", "ab", "ac", "bc", "abc"))


@query("leave_one_context_mean", with_facts(" SELECT replicate, context, intervention, feature, round((sum(value) OVER w - value) / (count(*) OVER w - 1), 6) AS loo FROM fact WINDOW w AS (PARTITION BY replicate, intervention, feature)"))
def _(spark, d):
    return rounded(interaction.leave_one_out_mean(facts(spark, d), "replicate", "intervention", "feature").select("replicate", "context", "intervention", "feature", "loo"))


@query("strict_leave_one_context_mean", with_facts(" SELECT a.replicate, a.context, a.intervention, a.feature, round(avg(b.value), 6) AS loo FROM fact a JOIN fact b USING (replicate, intervention, feature) WHERE a.context <> b.context GROUP BY ALL"))
def _(spark, d):
    return rounded(interaction.strict_leave_one_out_mean(facts(spark, d)).select("replicate", "context", "intervention", "feature", "loo"))


@query("all_but_one_deltas", with_facts(" SELECT replicate, context, intervention, feature, round(count(*) OVER w * (value - avg(value) OVER w) / (count(*) OVER w - 1), 6) AS delta FROM fact WINDOW w AS (PARTITION BY replicate, intervention, feature)"))
def _(spark, d):
    return rounded(interaction.all_but_one_deltas(facts(spark, d), "replicate", "intervention", "feature").select("replicate", "context", "intervention", "feature", "delta"))


GRAM = """,
g AS (SELECT a.intervention, a.context AS ctx_a, b.context AS ctx_b, a.replicate AS rep_a, b.replicate AS rep_b, sum(a.gamma * b.gamma) AS dot FROM gam a JOIN gam b ON a.intervention = b.intervention AND a.feature = b.feature GROUP BY ALL),
cg AS (SELECT ctx_a, ctx_b, sum(dot) AS dot FROM g WHERE rep_a = rep_b GROUP BY ALL)"""


def gram(spark, d):
    return interaction.gram(gamma(spark, d), "gamma")


@query("gram", with_facts(GAMMA + GRAM + " SELECT intervention, ctx_a, ctx_b, rep_a, rep_b, round(dot, 5) AS dot FROM g"))
def _(spark, d):
    return rounded(gram(spark, d), digits=5)


@query("centered_gram", with_facts(GAMMA + GRAM + " SELECT ctx_a, ctx_b, round(dot - avg(dot) OVER (PARTITION BY ctx_a) - avg(dot) OVER (PARTITION BY ctx_b) + avg(dot) OVER (), 5) AS dot FROM cg"))
def _(spark, d):
    return rounded(interaction.centered(interaction.context_gram(gram(spark, d))), digits=5)


@query("context_distances", with_facts(GAMMA + GRAM + """ SELECT p.ctx_a, p.ctx_b, round(sqrt(greatest(a.dot + b.dot - 2 * p.dot, 0) / 4), 5) AS distance, round(p.dot / sqrt(a.dot * b.dot), 5) AS cosine
FROM cg p JOIN cg a ON a.ctx_a = p.ctx_a AND a.ctx_b = p.ctx_a JOIN cg b ON b.ctx_a = p.ctx_b AND b.ctx_b = p.ctx_b WHERE p.ctx_a < p.ctx_b"""))
def _(spark, d):
    return rounded(interaction.gram_distances(interaction.context_gram(gram(spark, d)), 4), digits=5)


@query("energies_fgu", with_facts(GAMMA + ENERGY + """ SELECT context, round(sum(s), 5) AS s, round(sum(e), 5) AS e, CASE WHEN sum(s) > 0 THEN round(1 - sum(e) / sum(s), 5) END AS g, CASE WHEN tot > 0 THEN round(sum(s) / tot, 5) END AS f, CASE WHEN tot > 0 THEN round((sum(s) - sum(e)) / tot, 5) END AS u
FROM en, (SELECT sum(s) AS tot FROM en) GROUP BY context, tot"""))
def _(spark, d):
    by = energy(spark, d).groupBy("context").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    by = by.withColumn("full", F.sum("s").over(Window.partitionBy()))
    out = interaction.fgu(F.col("s"), F.col("e"), F.col("full"))
    return rounded(by.select("context", "s", "e", *(c.alias(k) for k, c in out.items())), digits=5)


@query("residual_energy", with_facts(GAMMA + GRAM + """, w AS (SELECT context, CASE WHEN i = 1 THEN 1.0 ELSE -1.0 / (n - 1) END AS w FROM (SELECT context, row_number() OVER (ORDER BY context) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT context FROM fact)))
SELECT intervention, round(sum(a.w * dot * b.w), 5) AS energy FROM g JOIN w a ON ctx_a = a.context JOIN w b ON ctx_b = b.context WHERE rep_a = 0 AND rep_b = 1 GROUP BY 1"""))
def _(spark, d):
    names = facts(spark, d).select("context").distinct()
    w = names.withColumn("i", F.row_number().over(Window.orderBy("context"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    w = w.select("context", F.when(F.col("i") == 1, 1.0).otherwise(-1.0 / (F.col("n") - 1)).alias("w"))
    return rounded(interaction.residual_energy(gram(spark, d), w), digits=5)


@query("complete_design", with_facts(" SELECT context FROM fact GROUP BY 1 HAVING count(DISTINCT (intervention, replicate, feature)) = (SELECT count(DISTINCT (intervention, replicate, feature)) FROM fact)"))
def _(spark, d):
    return interaction.complete(facts(spark, d))


@query("design_grid", with_facts(" SELECT c.context, i.intervention, p.replicate, max(f.context) IS NOT NULL AS observed FROM (SELECT DISTINCT context FROM fact) c, (SELECT DISTINCT intervention FROM fact) i, (SELECT DISTINCT replicate FROM fact) p LEFT JOIN fact f ON f.context = c.context AND f.intervention = i.intervention AND f.replicate = p.replicate GROUP BY ALL"))
def _(spark, d):
    return interaction.grid(facts(spark, d))


@query("axis_scores", with_facts(" SELECT replicate, context, intervention, axis, round(sum(value * weight), 6) AS score FROM fact JOIN (VALUES ('size', 'quantity', 0.6), ('size', 'price', 0.8), ('terms', 'discount', 0.8), ('terms', 'tax', -0.6)) l(axis, feature, weight) USING (feature) GROUP BY ALL"))
def _(spark, d):
    l = spark.createDataFrame([("size", "quantity", 0.6), ("size", "price", 0.8), ("terms", "discount", 0.8), ("terms", "tax", -0.6)], "axis string, feature string, weight double")
    return rounded(interaction.project(facts(spark, d), l))


@query("cell_features", with_facts(" SELECT replicate, context, intervention, list(round(value, 6) ORDER BY feature)::VARCHAR AS xs FROM fact GROUP BY ALL"))
def _(spark, d):
    p = interaction.packed(facts(spark, d))
    return p.select("replicate", "context", "intervention", F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: F.round(x, 6).cast("string")), ", "), F.lit("]")).alias("xs"))


# --- cohorts, joins, aggregates ---------------------------------------------------------

SALES_SQL = "WITH " + fact_sql()


@query("coverage", SALES_SQL + " SELECT n_name, p_type, count(*) AS n, count(DISTINCT o_custkey) AS units, round(sum(l_quantity), 4) AS total, min(l_quantity) AS low, median(l_quantity) AS mid, round(avg((l_discount > 0.05)::INT), 6) AS share, bool_or(l_discount > 0.05) AS any_flag, bool_and(l_discount > 0.05) AS all_flag, count(*) FILTER (l_discount > 0.05) AS flagged FROM sale GROUP BY ALL")
def _(spark, d):
    df = cohort.coverage(sales(spark, d), ["n_name", "p_type"], "o_custkey", "l_quantity", F.col("l_discount") > 0.05)
    return df.withColumns({"total": r("total", 4), "share": r("share")})


@query("covered_units", SALES_SQL + " SELECT o_custkey, count(DISTINCT p_brand) AS axes FROM sale GROUP BY 1 HAVING count(DISTINCT p_brand) >= 15")
def _(spark, d):
    return cohort.covered(sales(spark, d), "o_custkey", "p_brand", 15)


@query("ambiguous_excluded", "SELECT event_id, user_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts)) AS n FROM events) WHERE n = 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return cohort.exclude_ambiguous(e, ["user_id", "event_type", "hour"]).select("event_id", "user_id", "event_type")


@query("first_event", "SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(spark, d):
    return cohort.first_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("many_to_one_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return cohort.many_to_one(c, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("c_custkey", "n_name")


@query("outer_match", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, round(abs(a.v - b.v), 4) AS gap FROM (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority LIKE '2%' GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    o = table(spark, d, "orders")
    side = lambda p: o.filter(F.col("o_orderpriority").startswith(p)).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(cohort.outer_match(side("1"), side("2"), "k", "v"), digits=4)


@query("matched_controls", """WITH e AS (SELECT user_id % 7 AS donor, event_type AS state, event_id AS row, value > 20 AS target FROM events), t AS (SELECT *, donor::VARCHAR || '/' || state AS unit FROM e WHERE target), c AS (SELECT * FROM e WHERE NOT target),
n AS (SELECT donor, state, count(*) AS nc FROM c GROUP BY ALL), m AS (SELECT t.unit, t.row, t.donor, t.state, nc FROM t JOIN n USING (donor, state))
SELECT unit, row, round(sum(w), 6) AS weight FROM (SELECT unit, row, 1.0 AS w FROM m UNION ALL SELECT u.unit, c.row, u.w FROM (SELECT unit, donor, state, -count(*) / any_value(nc) AS w FROM m GROUP BY ALL) u JOIN c USING (donor, state)) GROUP BY ALL""")
def _(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("donor"), F.col("event_type").alias("state"), F.col("event_id").alias("row"), (F.col("value") > 20).alias("target"))
    e = e.withColumn("u", F.concat_ws("/", F.col("donor").cast("string"), "state"))
    return rounded(cohort.matched_control_weights(e, ["donor", "state"], F.col("target"), "u"))


@query("log_cpm", SALES_SQL + ", c AS (SELECT o_custkey AS sample, p_type AS feature, count(*) AS n FROM sale GROUP BY ALL) SELECT sample, feature, round(ln(1 + n * 1e6 / t), 6) AS log1p_cpm, round(log2(n * 1e6 / t + 1), 6) AS log2_cpm FROM c JOIN (SELECT sample, sum(n) AS t FROM c GROUP BY 1) USING (sample)")
def _(spark, d):
    c = sales(spark, d).groupBy(F.col("o_custkey").alias("sample"), F.col("p_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(cohort.log_cpm(c, "sample", "feature"))


@query("unit_rows", with_facts(" SELECT replicate, context, intervention, feature, round(x / sqrt(sum(x * x) OVER (PARTITION BY replicate, context, intervention)), 6) AS unit FROM (SELECT *, value - avg(value) OVER (PARTITION BY replicate, context, intervention) AS x FROM fact)"))
def _(spark, d):
    f = facts(spark, d).withColumn("row", F.struct("replicate", "context", "intervention"))
    return rounded(cohort.unit_rows(f, "row").select("replicate", "context", "intervention", "feature", "unit"))


@query("overlap_band", SALES_SQL + " SELECT round(max(q[1]), 4) AS low, round(min(q[2]), 4) AS high FROM (SELECT p_brand, quantile_cont(l_extendedprice, [0.05, 0.95]) AS q FROM sale GROUP BY 1)")
def _(spark, d):
    return rounded(cohort.overlap_band(sales(spark, d), "p_brand", "l_extendedprice"), digits=4)


@query("eta_squared", SALES_SQL + " SELECT round(sum((m - g) ** 2) / sum((v - g) ** 2), 6) AS eta2 FROM (SELECT l_extendedprice AS v, avg(l_extendedprice) OVER (PARTITION BY p_brand) AS m, avg(l_extendedprice) OVER () AS g FROM sale)")
def _(spark, d):
    return rounded(cohort.eta_squared(sales(spark, d), "p_brand", "l_extendedprice"))


@query("barcode_collisions", "WITH a AS (SELECT user_id, count(*) / sum(count(*)) OVER () AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) / sum(count(*)) OVER () AS p FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT count(*) AS shared, round(sum(a.p * b.p), 9) AS collision FROM a JOIN b USING (user_id)")
def _(spark, d):
    e = table(spark, d, "events")
    return rounded(cohort.barcode_collisions(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id"), digits=9)


@query("pivot_sums", SALES_SQL + " SELECT n_name, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'A'), 4), 0) AS A, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'N'), 4), 0) AS N, coalesce(round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4), 0) AS R FROM sale GROUP BY 1")
def _(spark, d):
    p = sales(spark, d).groupBy("n_name").pivot("l_returnflag", ["A", "N", "R"]).sum("l_quantity")
    return rounded(p.na.fill(0.0), digits=4)


@query("group_quantiles", SALES_SQL + " SELECT p_brand, round(q[1], 4) AS p10, round(q[2], 4) AS q25, round(q[3], 4) AS med, round(q[4], 4) AS q75, round(q[5], 4) AS p90, round(q[4] - q[2], 4) AS iqr FROM (SELECT p_brand, quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM sale GROUP BY 1)")
def _(spark, d):
    points = {0.1: "p10", 0.25: "q25", 0.5: "med", 0.75: "q75", 0.9: "p90"}
    q = ranks.quantiles(sales(spark, d).select("p_brand", "l_extendedprice"), ["p_brand"], "l_extendedprice", list(points))
    wide = q.groupBy("p_brand").agg(*(F.max(F.when(F.col("point") == p, F.col("q"))).alias(n) for p, n in points.items()))
    return rounded(wide.withColumn("iqr", F.col("q75") - F.col("q25")), digits=4)


@query("with_totals", SALES_SQL + " SELECT coalesce(r_name, 'all') AS r_name, coalesce(l_returnflag, 'all') AS l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM sale GROUP BY ROLLUP (r_name, l_returnflag)")
def _(spark, d):
    g = sales(spark, d).rollup("r_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean"))
    return g.select(F.coalesce("r_name", F.lit("all")).alias("r_name"), F.coalesce("l_returnflag", F.lit("all")).alias("l_returnflag"), "n", "mean")


@query("geometric_mean", SALES_SQL + " SELECT p_brand, round(exp(avg(ln(l_extendedprice))), 4) AS gm, mode(CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END) AS size FROM sale GROUP BY 1")
def _(spark, d):
    s = sales(spark, d).withColumn("size", F.when(F.col("l_quantity") > 25, "large").otherwise("small"))
    return rounded(s.groupBy("p_brand").agg(F.exp(F.avg(F.log("l_extendedprice"))).alias("gm"), F.mode("size", True).alias("size")), digits=4)


@query("block_shares", with_facts(" SELECT feature, context, round(abs(s) / sum(abs(s)) OVER (PARTITION BY feature), 6) AS share, round(sum(s) OVER (PARTITION BY feature) - s, 5) AS without FROM (SELECT feature, context, sum(value) AS s FROM fact GROUP BY ALL)"))
def _(spark, d):
    b = facts(spark, d).groupBy("feature", "context").agg(F.sum("value").alias("s"))
    w = Window.partitionBy("feature")
    return b.select("feature", "context", r(X.safe_ratio(F.abs("s"), F.sum(F.abs("s")).over(w))).alias("share"), r(F.sum("s").over(w) - F.col("s"), 5).alias("without"))


@query("intersection_of_contexts", with_facts(" SELECT intervention FROM fact WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT (context, replicate)) = (SELECT count(DISTINCT (context, replicate)) FROM fact)"))
def _(spark, d):
    f = facts(spark, d)
    want = f.agg(F.count_distinct("context", "replicate").alias("want"))
    return f.filter("value > 0").groupBy("intervention").agg(F.count_distinct("context", "replicate").alias("have")).join(F.broadcast(want), F.col("have") == F.col("want")).select("intervention")


@query("overlap_flags", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS in_f, bool_or(o_orderstatus = 'O') AS in_o, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS shared FROM orders GROUP BY 1")
def _(spark, d):
    f, o = F.bool_or(F.col("o_orderstatus") == "F"), F.bool_or(F.col("o_orderstatus") == "O")
    return table(spark, d, "orders").groupBy("o_custkey").agg(f.alias("in_f"), o.alias("in_o"), (f & o).alias("shared"))


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


# --- windows, ranks, order ----------------------------------------------------------------

@query("average_ranks", with_facts(" SELECT replicate, context, intervention, feature, rank() OVER (PARTITION BY replicate, context, feature ORDER BY v DESC) + (count(*) OVER (PARTITION BY replicate, context, feature, v) - 1) / 2.0::DOUBLE AS rank FROM (SELECT *, round(value) AS v FROM fact)"))
def _(spark, d):
    f = facts(spark, d).withColumn("v", F.round("value"))
    return f.select("replicate", "context", "intervention", "feature", X.average_rank(F.col("v"), "replicate", "context", "feature", descending=True).alias("rank"))


@query("top_brands", with_facts(" SELECT context, intervention, rank FROM (SELECT context, intervention, row_number() OVER (PARTITION BY context ORDER BY round(avg(value), 9) DESC, intervention)::INT AS rank FROM fact WHERE feature = 'price' GROUP BY context, intervention) WHERE rank <= 3"))
def _(spark, d):
    p = facts(spark, d).filter("feature = 'price'").groupBy("context", "intervention").agg(r(F.avg("value"), 9).alias("m"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("context").orderBy(F.col("m").desc(), "intervention"))).filter("rank <= 3").select("context", "intervention", "rank")


@query("cumulative_energy", with_facts(" SELECT context, feature, round(sum(q) OVER (PARTITION BY context ORDER BY feature) / sum(q) OVER (PARTITION BY context), 6) AS cum FROM (SELECT context, feature, sum(value * value) AS q FROM fact GROUP BY ALL)"))
def _(spark, d):
    q = facts(spark, d).groupBy("context", "feature").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    w = Window.partitionBy("context")
    return q.select("context", "feature", r(F.sum("q").over(w.orderBy("feature")) / F.sum("q").over(w)).alias("cum"))


@query("pareto_frontier", "WITH s AS (SELECT p_brand AS brand, count(*)::DOUBLE AS x, round(avg(p_retailprice), 6) AS y FROM part GROUP BY 1) SELECT brand, x, y FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))")
def _(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).cast("double").alias("x"), r(F.avg("p_retailprice")).alias("y"))
    return metrics.pareto(s, "x", "y", "brand")


@query("quantile_bins", "SELECT c_custkey, floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) * 4 / count(*) OVER (PARTITION BY c_nationkey))::INT AS bin FROM customer")
def _(spark, d):
    return design.quantile_bins(table(spark, d, "customer"), "c_acctbal", "c_custkey", 4, ["c_nationkey"]).select("c_custkey", "bin")


@query("parsimony_pick", with_facts(" SELECT context, arg_min(feature, (-round(s, 6), feature)) AS best, min(feature) FILTER (s >= 0.95 * m) AS simple FROM (SELECT *, max(s) OVER (PARTITION BY context) AS m FROM (SELECT context, feature, avg(value) AS s FROM fact GROUP BY ALL)) GROUP BY 1"))
def _(spark, d):
    s = facts(spark, d).groupBy("context", "feature").agg(F.avg("value").alias("s")).withColumn("m", F.max("s").over(Window.partitionBy("context")))
    return s.groupBy("context").agg(F.min_by("feature", F.struct((-r("s")).alias("s"), "feature")).alias("best"), F.min(F.when(F.col("s") >= 0.95 * F.col("m"), F.col("feature"))).alias("simple"))


@query("nearest_contexts", with_facts(GAMMA + GRAM + """ SELECT target, near, rank FROM (SELECT p.ctx_a AS target, p.ctx_b AS near, row_number() OVER (PARTITION BY p.ctx_a ORDER BY round(a.dot + b.dot - 2 * p.dot, 5), p.ctx_b)::INT AS rank FROM cg p JOIN cg a ON a.ctx_a = p.ctx_a AND a.ctx_b = p.ctx_a JOIN cg b ON b.ctx_a = p.ctx_b AND b.ctx_b = p.ctx_b WHERE p.ctx_a <> p.ctx_b) WHERE rank <= 3"""))
def _(spark, d):
    cg = interaction.context_gram(gram(spark, d))
    own = cg.filter("ctx_a = ctx_b").select(F.col("ctx_a").alias("c"), F.col("dot").alias("sq"))
    p = cg.filter("ctx_a <> ctx_b").join(own.withColumnsRenamed({"c": "ctx_a", "sq": "aa"}), "ctx_a").join(own.withColumnsRenamed({"c": "ctx_b", "sq": "bb"}), "ctx_b")
    rank = F.row_number().over(Window.partitionBy("ctx_a").orderBy(r(F.col("aa") + F.col("bb") - 2 * F.col("dot"), 5), "ctx_b"))
    return p.select(F.col("ctx_a").alias("target"), F.col("ctx_b").alias("near"), rank.alias("rank")).filter("rank <= 3")


@query("monotone_gate", "SELECT count(*) AS violations FROM (SELECT o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) WHERE step <= 0")
def _(spark, d):
    step = F.col("o_orderkey") - F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(step.alias("step")).filter("step <= 0").agg(F.count(F.lit(1)).alias("violations"))


# --- design ---------------------------------------------------------------------------------

@query("hash_folds", """SELECT c_custkey, (('0x' || array_to_string([substr(sha256(c_name), 15 - 2 * i, 2) for i in range(8)], ''))::UBIGINT % 5)::INT AS fold FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.hash_fold(F.col("c_name"), 5).alias("fold"))


@query("stride_folds", "SELECT n_name, ((row_number() OVER (ORDER BY sha256('7|' || n_name)) - 1) % 5)::INT AS fold FROM nation")
def _(spark, d):
    return design.stride_folds(table(spark, d, "nation"), "n_name", "7")


@query("contiguous_folds", "SELECT n_name, (CASE WHEN i < m * (q + 1) THEN floor(i / (q + 1)) ELSE m + floor((i - m * (q + 1)) / q) END)::INT AS fold FROM (SELECT n_name, row_number() OVER (ORDER BY sha256('7|' || n_name)) - 1 AS i, count(*) OVER () // 4 AS q, count(*) OVER () % 4 AS m FROM nation)")
def _(spark, d):
    return design.contiguous_folds(table(spark, d, "nation"), "n_name", "7", 4)


@query("stratified_folds", "SELECT doc_id, quality, fold, (fold + 1) % 5 AS calibration FROM (SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY sha256('3|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels)")
def _(spark, d):
    return design.stratified_folds(table(spark, d, "labels"), "doc_id", "quality", "3")


@query("leave_one_donor_out", "SELECT a.r_name AS held, b.r_name AS unit, CASE WHEN a.r_name = b.r_name THEN 'outer_test' ELSE 'outer_train' END AS role FROM region a, region b")
def _(spark, d):
    return design.leave_one_out(table(spark, d, "region"), "r_name")


@query("support_ladder", "SELECT held, sequence, rung, unit FROM (SELECT a.n_name AS held, s::INT AS sequence, b.n_name AS unit, row_number() OVER (PARTITION BY a.n_name, s ORDER BY sha256(s || '|' || a.n_name || '|' || b.n_name)) AS rank FROM nation a JOIN nation b ON a.n_name <> b.n_name, range(3) t(s)), (VALUES (2), (4), (8)) v(rung) WHERE rank <= rung")
def _(spark, d):
    return design.support_ladder(table(spark, d, "nation"), "n_name", 3, [2, 4, 8])


@query("latin_masks", with_facts(" SELECT context, intervention, ((dense_rank() OVER (ORDER BY intervention) - 1 + 2 * (dense_rank() OVER (ORDER BY context) - 1)) % 5)::INT AS fold FROM (SELECT DISTINCT context, intervention FROM fact)"))
def _(spark, d):
    return design.latin_masks(facts(spark, d))


@query("derangement", "SELECT n_name, coalesce(lead(n_name) OVER w, first_value(n_name) OVER w) AS partner FROM nation WINDOW w AS (ORDER BY sha256('5|' || n_name))")
def _(spark, d):
    return design.derangement(table(spark, d, "nation"), "n_name", "5")


@query("shuffled_blocks", "WITH a AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('2|' || c_custkey), c_custkey) AS j FROM customer) SELECT a.c_nationkey, a.c_custkey, a.c_acctbal, b.c_acctbal AS shuffled FROM a JOIN a b ON a.c_nationkey = b.c_nationkey AND a.i = b.j")
def _(spark, d):
    return design.shuffle_within(table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal", "2")


@query("hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('9|' || o_orderkey), o_orderkey LIMIT 100")
def _(spark, d):
    return design.hash_sample(table(spark, d, "orders"), "o_orderkey", "9", 100).select("o_orderkey", "o_totalprice")


@query("split_leaks", "SELECT user_id, count(*) AS parts FROM (SELECT DISTINCT user_id, event_id % 3 AS p FROM events) GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    e = table(spark, d, "events")
    return design.leaks([e.filter(F.col("event_id") % 3 == k) for k in range(3)], "user_id")


@query("compressed_ranges", "SELECT min(v) AS first, max(v) AS last FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT DISTINCT o_custkey AS v FROM orders)) GROUP BY g")
def _(spark, d):
    return design.compress_ranges(table(spark, d, "orders"), "o_custkey")


# --- metrics --------------------------------------------------------------------------------

PRED = """, p AS (SELECT *, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS pred FROM fact WINDOW w AS (PARTITION BY replicate, intervention, feature))"""


def predicted(spark, d):
    return interaction.leave_one_out_mean(facts(spark, d), "replicate", "intervention", "feature")


@query("recovery", with_facts(PRED + " SELECT context, round(sum(value * value), 4) AS truth_energy, round(1 - sum((value - pred) ** 2) / sum(value * value), 6) AS g, round(sum(value * pred) / sum(pred * pred), 6) AS alpha, round(sqrt(sum(pred * pred)) / sqrt(sum(value * value)), 6) AS kappa, round(sum(value * pred) / sqrt(sum(value * value) * sum(pred * pred)), 6) AS cosine, round(corr(value, pred), 6) AS pearson FROM p GROUP BY 1"))
def _(spark, d):
    m = metrics.recovery(predicted(spark, d), ["context"], F.col("value"), F.col("loo"))
    return rounded(m, "truth_energy").withColumn("truth_energy", r("truth_energy", 4))


@query("feature_r2", with_facts(PRED + " SELECT feature, round(1 - sum((value - pred) ** 2) / (count(*) * var_pop(value)), 6) AS r2 FROM p GROUP BY 1"))
def _(spark, d):
    return rounded(metrics.feature_r2(predicted(spark, d), "feature", F.col("value"), F.col("loo")))


@query("spearman", with_facts(PRED + ", k AS (SELECT context, feature, rank() OVER (PARTITION BY context, feature ORDER BY round(value, 8)) + (count(*) OVER (PARTITION BY context, feature, round(value, 8)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY context, feature ORDER BY round(pred, 8)) + (count(*) OVER (PARTITION BY context, feature, round(pred, 8)) - 1) / 2.0 AS b FROM p) SELECT context, feature, round(corr(a, b), 6) AS rho FROM k GROUP BY ALL"))
def _(spark, d):
    p = predicted(spark, d).withColumns({"value": r("value", 8), "loo": r("loo", 8)})
    return rounded(metrics.spearman(p, ["context", "feature"], "value", "loo"))


SCORE = """, sc AS (SELECT context AS unit, intervention AS item, round(avg(value), 8) AS t, round(avg(pred), 8) AS q, round(avg(pop), 8) AS o FROM (SELECT *, avg(value) OVER (PARTITION BY intervention, feature) AS pop FROM p) WHERE feature = 'price' GROUP BY ALL)"""


def scores(spark, d):
    p = predicted(spark, d).filter("feature = 'price'").withColumn("pop", F.avg("value").over(Window.partitionBy("intervention")))
    return p.groupBy(F.col("context").alias("unit"), F.col("intervention").alias("item")).agg(r(F.avg("value"), 8).alias("t"), r(F.avg("loo"), 8).alias("q"), r(F.avg("pop"), 8).alias("o"))


@query("kendall_tau", with_facts(PRED + SCORE + " SELECT a.unit, round(sum(sign(a.t - b.t) * sign(a.q - b.q)) / sqrt(sum(sign(a.t - b.t) ** 2) * sum(sign(a.q - b.q) ** 2)), 6) AS tau FROM sc a JOIN sc b ON a.unit = b.unit AND a.item < b.item GROUP BY 1"))
def _(spark, d):
    return rounded(metrics.kendall(scores(spark, d), "unit", "item", "t", "q"))


@query("preference_reversals", with_facts(PRED + SCORE + """, x AS (SELECT a.unit, CASE WHEN abs(a.t - b.t) <= 0.01 THEN 0 ELSE sign(a.t - b.t) END AS t, CASE WHEN abs(a.q - b.q) <= 0.01 THEN 0 ELSE sign(a.q - b.q) END AS p, CASE WHEN abs(a.o - b.o) <= 0.01 THEN 0 ELSE sign(a.o - b.o) END AS o FROM sc a JOIN sc b ON a.unit = b.unit AND a.item < b.item),
y AS (SELECT unit, count(*) FILTER (t <> o AND p <> o AND p <> 0) AS tp, count(*) FILTER (t = o AND p <> o AND p <> 0) AS fp, count(*) FILTER (t <> o AND NOT (p <> o AND p <> 0)) AS fn, count(*) FILTER (t = o AND NOT (p <> o AND p <> 0)) AS tn FROM x WHERE t <> 0 AND o <> 0 GROUP BY 1)
SELECT unit, tp, fp, fn, tn, round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END) / 2, 6) AS balanced_accuracy, round(CASE WHEN sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM y"""))
def _(spark, d):
    return rounded(metrics.reversals(scores(spark, d), "unit", "item", "t", "q", "o", 0.01))


@query("topk_overlap", with_facts(PRED + SCORE + ", a AS (SELECT unit, item FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t DESC, item) AS k FROM sc) WHERE k <= 5), b AS (SELECT unit, item FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY q DESC, item) AS k FROM sc) WHERE k <= 5) SELECT coalesce(a.unit, b.unit) AS unit, count(*) FILTER (a.item IS NOT NULL AND b.item IS NOT NULL) / 5 AS overlap, bool_and(a.item IS NOT NULL AND b.item IS NOT NULL) AS exact FROM a FULL JOIN b ON a.unit = b.unit AND a.item = b.item GROUP BY 1"))
def _(spark, d):
    return metrics.topk_overlap(scores(spark, d), "unit", "item", "t", "q", 5)


PROB = "WITH l AS (SELECT doc_id, quality, (('0x' || substr(sha256('p|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0) * 0.6 + quality * 0.3 AS p FROM labels)"


def probabilities(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality", (X.hash_uniform(F.lit("p"), F.col("doc_id")) * 0.6 + F.col("quality") * 0.3).alias("p"))


@query("auroc", PROB + " SELECT round(sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM l a JOIN l b ON a.quality = 1 AND b.quality = 0")
def _(spark, d):
    return rounded(metrics.auroc(probabilities(spark, d), "p", "quality"))


@query("classification", PROB + " SELECT quality_group, round(avg(((p > 0.5)::INT = quality)::INT), 6) AS accuracy, round(avg(((1 - p - (1 - quality)) ** 2 + (p - quality) ** 2) / 2), 6) AS brier, round(avg(-ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END)), 6) AS logloss, round((avg((p > 0.5)::INT) FILTER (quality = 1) + avg((p <= 0.5)::INT) FILTER (quality = 0)) / 2, 6) AS balanced_accuracy FROM (SELECT *, doc_id % 3 AS quality_group FROM l) GROUP BY 1")
def _(spark, d):
    p = probabilities(spark, d).withColumn("quality_group", F.col("doc_id") % 3)
    return rounded(metrics.classification(p, ["quality_group"], F.array(1 - F.col("p"), F.col("p")), F.col("quality")))


@query("conformal_cuts", PROB + ", s AS (SELECT quality, 1 - CASE WHEN quality = 1 THEN p ELSE 1 - p END AS score FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY score) AS i, ceil((count(*) OVER (PARTITION BY quality) + 1) * (1 - 0.1)) AS need FROM s) SELECT quality, round(coalesce(min(score) FILTER (i = need), 'inf'::DOUBLE), 6) AS cut FROM k GROUP BY 1")
def _(spark, d):
    p = probabilities(spark, d).withColumn("score", 1 - F.when(F.col("quality") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return rounded(models.conformal_cut(p, ["quality"], "score", 0.1))


SIMS = "WITH e AS (SELECT label, vec_id % 2 AS h, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), v AS (SELECT label, h, i, avg(x) AS x FROM e GROUP BY ALL), m AS (SELECT a.label AS q, b.label AS t, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS s FROM v a JOIN v b USING (i) WHERE a.h = 0 AND b.h = 1 GROUP BY ALL)"


def similarities(spark, d):
    """Every label's mean vector over one half of its vectors against every label's over the other half; equal labels belong together."""
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("h"), F.posexplode("embedding").alias("i", "x"))
    v = e.groupBy("label", "h", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    a, b = (v.filter(F.col("h") == h).select("i", F.col("label").alias(k), F.col("x").alias(f"x{k}")) for h, k in ((0, "q"), (1, "t")))
    x, y = F.col("xq"), F.col("xt")
    return a.join(b, "i").groupBy("q", "t").agg(r(F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("s"))


@query("identity_retrieval", SIMS + " SELECT m.q, count(*) FILTER (m.s > o.s AND m.q <> m.t) + 1 AS rank, round(any_value(o.s), 6) AS matched, round(median(m.s) FILTER (m.q <> m.t), 5) AS mismatched FROM m JOIN m o ON o.q = m.q AND o.t = m.q GROUP BY 1")
def _(spark, d):
    return rounded(metrics.retrieval(similarities(spark, d), "q", "t", "s"), "mismatched").withColumn("mismatched", r("mismatched", 5))


@query("retrieval_summary", SIMS + ", k AS (SELECT m.q, count(*) FILTER (m.s > o.s AND m.q <> m.t) + 1 AS r FROM m JOIN m o ON o.q = m.q AND o.t = m.q GROUP BY 1) SELECT round(avg(1 / r), 6) AS mrr, round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 5)::INT), 6) AS top5, round(avg(r), 6) AS mean_rank, round(avg(1 - (r - 1) / ((SELECT count(DISTINCT label) FROM embeddings) - 1.0)), 6) AS percentile FROM k")
def _(spark, d):
    return rounded(metrics.retrieval_summary(metrics.retrieval(similarities(spark, d), "q", "t", "s"), table(spark, d, "embeddings").select("label").distinct().count()))


@query("spectrum", with_facts(GAMMA + ", c AS (SELECT context, p.feature, covar_pop(p.gamma, q.gamma) AS pq, var_pop(p.gamma) AS pp, var_pop(q.gamma) AS qq FROM gam p JOIN gam q USING (replicate, context, intervention) WHERE (p.feature = 'price' AND q.feature = 'quantity') OR (p.feature = 'discount' AND q.feature = 'tax') GROUP BY ALL), v AS (SELECT context, unnest([(pp + qq) / 2 + sqrt((pp - qq) ** 2 / 4 + pq * pq), (pp + qq) / 2 - sqrt((pp - qq) ** 2 / 4 + pq * pq)]) AS v FROM c), w AS (SELECT row_number() OVER (ORDER BY v DESC)::INT AS i, v / sum(v) OVER () AS p, sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS c FROM v) SELECT round(1 / sum(p * p), 5) AS participation, round(exp(-sum(p * ln(p))), 5) AS entropy_rank, min(i) FILTER (c >= 0.5 - 1e-12) AS k50, min(i) FILTER (c >= 0.9 - 1e-12) AS k90 FROM w"))
def _(spark, d):
    """Eigenvalues of each context's covariances of amounts and of rates, all together; the SQL has them in closed form."""
    kind = F.when(F.col("feature").isin("price", "quantity"), "amounts").otherwise("rates")
    g = gamma(spark, d).withColumn("group", F.concat_ws("|", "context", kind))
    return rounded(metrics.spectrum(decompose.eigenvalues(g, "group", "feature", ["replicate", "intervention"], "gamma"), "eigenvalue"), digits=5)


# --- resampling and inference -----------------------------------------------------------------

DRAWS = """, ax AS (SELECT context, row_number() OVER (ORDER BY context) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT context FROM en)),
pk AS (SELECT d.draw, floor((('0x' || substr(sha256('11|' || d.draw || '|' || ax.i), 1, 13))::BIGINT / 4503599627370496.0) * ax.n)::INT AS i FROM ax, range(200) d(draw)),
dr AS (SELECT draw, context, count(*) AS times FROM pk JOIN ax USING (i) GROUP BY ALL),
gd AS (SELECT draw, CASE WHEN sum(times * s) > 0 THEN 1 - sum(times * e) / sum(times * s) END AS g FROM dr JOIN (SELECT context, sum(s) AS s, sum(e) AS e FROM en GROUP BY 1) USING (context) GROUP BY 1)"""


def g_draws(spark, d):
    by = energy(spark, d).groupBy("context").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    return inference.ratio_draws(inference.unit_draws(by, "context", 200, "11"), by, ["context"])


@query("bootstrap_counts", with_facts(GAMMA + ENERGY + DRAWS + " SELECT draw::INT AS draw, context, times FROM dr"))
def _(spark, d):
    return inference.unit_draws(facts(spark, d), "context", 200, "11")


@query("bootstrap_g", with_facts(GAMMA + ENERGY + DRAWS + " SELECT draw::INT AS draw, round(g, 5) AS g FROM gd"))
def _(spark, d):
    return rounded(g_draws(spark, d), digits=5)


@query("bootstrap_interval", with_facts(GAMMA + ENERGY + DRAWS + " SELECT 'g' AS metric, round(quantile_cont(g, 0.025), 5) AS low, round(quantile_cont(g, 0.975), 5) AS high, round(avg((g > 0)::INT), 6) AS positive FROM gd"))
def _(spark, d):
    return rounded(inference.interval(g_draws(spark, d).withColumn("metric", F.lit("g")), ["metric"], "g"), digits=5)


PVALS = "WITH p AS (SELECT n_name, (('0x' || substr(sha256('h|' || n_name), 1, 13))::BIGINT / 4503599627370496.0) / 10 AS p FROM nation)"


def p_values(spark, d):
    return table(spark, d, "nation").select("n_name", (X.hash_uniform(F.lit("h"), F.col("n_name")) / 10).alias("p"))


@query("holm", PVALS + ", s AS (SELECT n_name, p, p * (count(*) OVER () - row_number() OVER (ORDER BY p, n_name) + 1) AS x FROM p) SELECT n_name, round(least(1, max(x) OVER (ORDER BY p, n_name ROWS UNBOUNDED PRECEDING)), 9) AS holm FROM s")
def _(spark, d):
    return rounded(inference.holm(p_values(spark, d), "p", "n_name").select("n_name", "holm"), digits=9)


@query("benjamini_hochberg", PVALS + ", s AS (SELECT n_name, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, n_name) AS x FROM p) SELECT n_name, round(least(1, min(x) OVER (ORDER BY p, n_name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS bh FROM s")
def _(spark, d):
    return rounded(inference.benjamini_hochberg(p_values(spark, d), "p", "n_name").select("n_name", "bh"), digits=9)


@query("fieller_interval", """WITH a AS (SELECT count(*) AS n, avg(l_discount) AS a, avg(l_tax) AS b, var_samp(l_discount) AS va, var_samp(l_tax) AS vb, covar_samp(l_discount, l_tax) AS vab FROM lineitem), q AS (SELECT a / b AS ratio, b * b - 1.959963984540054 ** 2 / n * vb AS qa, a * b - 1.959963984540054 ** 2 / n * vab AS qb, a * a - 1.959963984540054 ** 2 / n * va AS qc FROM a)
SELECT round(ratio, 6) AS ratio, qa > 0 AND qb * qb - qa * qc >= 0 AS bounded, round((qb - sqrt(qb * qb - qa * qc)) / qa, 6) AS low, round((qb + sqrt(qb * qb - qa * qc)) / qa, 6) AS high FROM q""")
def _(spark, d):
    return rounded(inference.fieller(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@query("dominance", "SELECT a.p_brand AS a, b.p_brand AS b, round(avg(CASE WHEN a.p_size < b.p_size THEN 1 WHEN a.p_size = b.p_size THEN 0.5 ELSE 0 END), 6) AS p FROM part a JOIN part b ON a.p_brand < b.p_brand GROUP BY ALL")
def _(spark, d):
    return rounded(inference.dominance(table(spark, d, "part"), "p_brand", "p_size"))


@query("mid_percentile", "SELECT round((count(*) FILTER (p_size < 25) + 0.5 * count(*) FILTER (p_size = 25)) / count(*), 6) AS percentile FROM part")
def _(spark, d):
    return rounded(inference.mid_percentile(table(spark, d, "part"), F.col("p_size"), F.lit(25)))


@query("saturation_thresholds", with_facts(", c AS (SELECT context, feature, dense_rank() OVER (PARTITION BY context ORDER BY feature)::INT AS k, round(sum(q) OVER (PARTITION BY context ORDER BY feature) / sum(q) OVER (PARTITION BY context), 9) AS ret FROM (SELECT context, feature, sum(value * value) AS q FROM fact GROUP BY ALL)) SELECT context, level, min(k) FILTER (ret >= level) AS k FROM c, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) v(level) GROUP BY ALL"))
def _(spark, d):
    q = facts(spark, d).groupBy("context", "feature").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    w = Window.partitionBy("context")
    c = q.select("context", F.row_number().over(w.orderBy("feature")).alias("k"), r(F.sum("q").over(w.orderBy("feature")) / F.sum("q").over(w), 9).alias("ret"))
    return inference.thresholds(c, ["context"], "k", "ret", [0.5, 0.9])


@query("ols_router", SALES_SQL + " SELECT p_brand, round(CASE WHEN count(*) < 8 THEN 0 ELSE regr_slope(l_extendedprice, l_quantity) END, 4) AS slope, round(CASE WHEN count(*) < 8 THEN avg(l_extendedprice) ELSE regr_intercept(l_extendedprice, l_quantity) END, 4) AS intercept FROM sale GROUP BY 1")
def _(spark, d):
    return rounded(models.ols(sales(spark, d), ["p_brand"], "l_quantity", "l_extendedprice"), digits=4)


@query("scaling_curve", """WITH p AS (SELECT c_mktsegment AS curve, k::DOUBLE AS x, round(avg(c_acctbal) FILTER (c_custkey % 10 < k), 4) AS y FROM customer, range(2, 10) t(k) GROUP BY ALL), z AS (SELECT curve, rate, y, exp(-rate * x) AS z FROM p, (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (1.0::DOUBLE)) v(rate)),
f AS (SELECT curve, rate, regr_intercept(y, z) AS a, regr_slope(y, z) AS b, regr_syy(y, z) - regr_slope(y, z) * regr_sxy(y, z) AS sse FROM z GROUP BY ALL) SELECT curve, arg_min(rate, sse) AS rate, round(arg_min(a, sse), 3) AS a, round(arg_min(b, sse), 3) AS b, round(min(sse), 3) AS sse FROM f GROUP BY 1""")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("x", F.explode(F.sequence(F.lit(2), F.lit(9)))).filter(F.col("c_custkey") % 10 < F.col("x"))
    p = c.groupBy(F.col("c_mktsegment").alias("curve"), F.col("x").cast("double").alias("x")).agg(r(F.avg("c_acctbal"), 4).alias("y"))
    return rounded(models.saturating_fit(p, "curve", "x", "y", [0.1, 0.3, 1.0]), "rate", digits=3)


# --- functions ----------------------------------------------------------------------------------

@query("json_and_text", "SELECT event_id, (props::JSON ->> 'k')::INT AS k, upper(trim(event_type)) AS kind, regexp_replace('a_b_' || event_id, '_[^_]*$', '') AS head, substr(sha256(event_id::VARCHAR), 1, 8) AS tag FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.upper(F.trim("event_type")).alias("kind"), X.drop_last_token(F.concat(F.lit("a_b_"), F.col("event_id").cast("string"))).alias("head"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8).alias("tag"))


@query("natural_order_ids", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS number, row_number() OVER (ORDER BY regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT)::INT AS place FROM customer")
def _(spark, d):
    number = F.regexp_extract("c_name", "([0-9]+)$", 1).cast("bigint")
    rows = table(spark, d, "customer").select("c_custkey", number.alias("number"))
    return ranks.numbered(rows, F.col("number").asc(), F.col("c_custkey").asc()).withColumn("place", F.col("place").cast("int"))


@query("joined_distinct", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments, sha256(string_agg(c_name, chr(10) ORDER BY c_name)) AS digest FROM customer GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(X.join_distinct(F.col("c_mktsegment")).alias("segments"), X.line_digest(F.col("c_name")).alias("digest"))


@query("vector_features", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(x::DOUBLE, 0))), 5) AS positive, round(list_sum(list_transform(embedding, lambda x: greatest(-x::DOUBLE, 0))), 5) AS negative, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) ** 2, 4) AS outer_sum FROM embeddings")
def _(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    split = X.signed_split(x)
    return table(spark, d, "embeddings").select("vec_id", r(total(F.slice(split, 1, F.size(x))), 5).alias("positive"), r(total(F.slice(split, F.size(x) + 1, F.size(x))), 5).alias("negative"), r(total(X.outer(x, x)), 4).alias("outer_sum"))


@query("windowed_events", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return rounded(windowed(table(spark, d, "events"), "ts", "event_type", "value"), digits=4).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- dense solves: checked against NumPy in the tests -----------------------------------------------

@query("affine_ridge_weights")
def _(spark, d):
    return models.fit_affine(interaction.context_gram(gram(spark, d)), 0.1)


@query("affine_ridge_prediction")
def _(spark, d):
    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    return models.weighted_prediction(g, models.fit_affine(interaction.context_gram(interaction.gram(g)), 0.1))


@query("kernel_ridge")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").cast("double").alias("y"))
    return models.landmark_ridge(e, e.select("id", X.hash_fold(F.col("id").cast("string"), 5).cast("int").alias("fold")), 0.1, 64)


@query("fisher_overlap")
def _(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("a"))
    row, col, every = Window.partitionBy("c_mktsegment"), Window.partitionBy("c_nationkey"), Window.partitionBy()
    c = c.withColumn("b", F.sum("a").over(row) - F.col("a")).withColumn("c", F.sum("a").over(col) - F.col("a")).withColumn("d", F.sum("a").over(every) - F.col("a") - F.col("b") - F.col("c"))
    return c.select("c_mktsegment", "c_nationkey", inference.fisher_greater("a", "b", "c", "d").alias("p"), inference.fisher_two_sided("a", "b", "c", "d").alias("two_sided"))


# --- reliable energies, nulls, gates --------------------------------------------------------------

DONOR = "WITH c AS (SELECT r_name AS donor, l_returnflag AS state, p_type AS intervention, avg(l_discount * 100) AS discount, avg(l_extendedprice / 1000) AS price, avg(l_quantity) AS quantity, avg(l_tax * 100) AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE r_name <> 'ASIA' GROUP BY ALL), df AS (SELECT donor, state, intervention, unnest(['discount', 'price', 'quantity', 'tax']) AS feature, unnest([discount, price, quantity, tax]) AS value FROM c)"
DISJOINT = DONOR + """, pt(partition, a, b) AS (VALUES (0, 'AFRICA', 'AMERICA'), (1, 'AFRICA', 'EUROPE'), (2, 'AFRICA', 'MIDDLE EAST')),
hf AS (SELECT partition, CASE WHEN donor IN (a, b) THEN 0 ELSE 1 END AS half, intervention, state, feature, avg(value) AS v FROM df, pt GROUP BY ALL),
di AS (SELECT x.partition, x.half, x.intervention, x.feature, x.state AS state_a, y.state AS state_b, x.v - y.v AS d FROM hf x JOIN hf y ON x.partition = y.partition AND x.half = y.half AND x.intervention = y.intervention AND x.feature = y.feature AND x.state < y.state),
ce AS (SELECT *, d - avg(d) OVER (PARTITION BY partition, half, feature, state_a, state_b) AS z FROM di),
ds AS (SELECT l.partition, l.intervention, l.state_a, l.state_b, avg(l.z * r.z) AS distance FROM ce l JOIN ce r ON l.partition = r.partition AND l.intervention = r.intervention AND l.feature = r.feature AND l.state_a = r.state_a AND l.state_b = r.state_b AND l.half = 0 AND r.half = 1 GROUP BY ALL)"""


def donors(spark, d):
    s = sales(spark, d).filter("r_name <> 'ASIA'")
    return response_of(s.groupBy(F.col("r_name").alias("donor"), F.col("l_returnflag").alias("state"), F.col("p_type").alias("intervention")).agg(*(F.avg(c).alias(n) for n, c in measures().items())), ["donor", "state", "intervention"])


def response_of(df, keys):
    return df.unpivot(keys, sorted(measures()), "feature", "value")


def disjoint(spark, d):
    return signal.disjoint_distances(donors(spark, d), signal.half_partitions(spark, ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"]))


@query("donor_disjoint_distances", DISJOINT + " SELECT partition, intervention, state_a, state_b, round(distance, 7) AS distance FROM ds")
def _(spark, d):
    return rounded(disjoint(spark, d), digits=7)


@query("distance_summary", DISJOINT + " SELECT state_a, state_b, round(avg(distance), 7) AS mean, round(median(distance), 7) AS mid, round(avg((distance > 0)::INT), 6) AS positive, any_value(pp) AS positive_partitions FROM ds JOIN (SELECT state_a, state_b, count(*) FILTER (m > 0) AS pp FROM (SELECT state_a, state_b, partition, avg(distance) AS m FROM ds GROUP BY ALL) GROUP BY ALL) USING (state_a, state_b) GROUP BY ALL")
def _(spark, d):
    return rounded(signal.distance_summary(disjoint(spark, d)), digits=7).withColumn("positive", r("positive"))


@query("reliable_shares", with_facts(GAMMA + ", h AS (SELECT a.gamma AS g0, b.gamma AS g1, a.value - a.gamma AS m0, b.value - b.gamma AS m1 FROM gam a JOIN gam b USING (context, intervention, feature) WHERE a.replicate = 0 AND b.replicate = 1), e AS (SELECT greatest(sum(g0 * g1), 0) AS interaction, greatest(sum(m0 * m1), 0) AS main FROM h), l AS (SELECT unnest(['interaction', 'main']) AS component, unnest([interaction, main]) AS energy FROM e) SELECT component, round(energy, 4) AS energy, round(energy / sum(energy) OVER (), 6) AS share FROM l"))
def _(spark, d):
    g = gamma(spark, d).withColumns({"interaction": F.col("gamma"), "main": F.col("value") - F.col("gamma")})
    s = signal.reliable_shares(interaction.cross_replicate(g, "interaction", "main"), ["interaction", "main"])
    return s.select("component", r("energy", 4).alias("energy"), r("share").alias("share"))


@query("context_distance", with_facts(GAMMA + " SELECT ctx_a, ctx_b, round(avg(d), 6) AS distance FROM (SELECT a.context AS ctx_a, b.context AS ctx_b, a.replicate, a.intervention, sqrt(avg((a.gamma - b.gamma) ** 2)) AS d FROM gam a JOIN gam b ON a.replicate = b.replicate AND a.intervention = b.intervention AND a.feature = b.feature AND a.context < b.context GROUP BY ALL) GROUP BY ALL", "r_name"))
def _(spark, d):
    return rounded(signal.context_distance(gamma(spark, d, "r_name"), "gamma"))


@query("weighted_error", with_facts(GAMMA + GRAM + ", w AS (SELECT a.c AS context, b.c AS s, CASE WHEN a.c = b.c THEN -1.0 ELSE 1.0 / (n - 1) END AS w FROM (SELECT DISTINCT ctx_a AS c FROM cg) a, (SELECT DISTINCT ctx_a AS c FROM cg) b, (SELECT count(DISTINCT ctx_a) AS n FROM cg)) SELECT x.context, round(sum(x.w * y.w * dot), 4) AS error FROM w x JOIN w y ON x.context = y.context JOIN cg ON ctx_a = x.s AND ctx_b = y.s GROUP BY 1"))
def _(spark, d):
    g = interaction.context_gram(gram(spark, d))
    names = g.select(F.col("ctx_a").alias("context")).distinct()
    w = names.join(names.withColumnRenamed("context", "source"), F.col("context") != F.col("source")).withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("context")))
    return rounded(signal.weighted_error(g, w), digits=4)


@query("stratified_permutation", "WITH b AS (SELECT c_nationkey, c_custkey, c_mktsegment, draw FROM customer, range(3) t(draw)), a AS (SELECT *, row_number() OVER (PARTITION BY draw, c_nationkey ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY draw, c_nationkey ORDER BY sha256('sp|' || draw || '|' || c_custkey), c_custkey) AS j FROM b) SELECT a.draw::INT AS draw, a.c_nationkey, a.c_custkey, a.c_mktsegment, o.c_mktsegment AS shuffled FROM a JOIN a o ON a.draw = o.draw AND a.c_nationkey = o.c_nationkey AND a.i = o.j")
def _(spark, d):
    return signal.permuted(table(spark, d, "customer"), "c_custkey", "c_mktsegment", ["c_nationkey"], 3, "sp")


@query("influence", with_facts(GAMMA + ENERGY + ", b AS (SELECT context, sum(s) AS s, sum(e) AS e FROM en GROUP BY 1) SELECT context, CASE WHEN sum(s) OVER () - s > 0 THEN round(1 - (sum(e) OVER () - e) / (sum(s) OVER () - s), 5) END AS g_without FROM b"))
def _(spark, d):
    return rounded(signal.influence(energy(spark, d), "context"), digits=5)


@query("guide_halves", "SELECT p_partkey, p_brand, CASE WHEN i % 2 = 1 THEN 'A' ELSE 'B' END AS half FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('gh|' || p_partkey), p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE n >= 2")
def _(spark, d):
    return signal.guide_halves(table(spark, d, "part"), "p_partkey", "p_brand", "gh")


@query("integrity_checks", "SELECT 'orders have customers' AS name, count(*) = 0 AS passed, count(*) || ' violations' AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'keys are unique', count(*) = 0, count(*) || ' violations' FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'discounts stay small', count(*) = 0, count(*) || ' violations' FROM lineitem WHERE l_discount > 0.08")
def _(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    lost = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return signal.checks(("orders have customers", lost), ("keys are unique", o.groupBy("o_orderkey").count().filter("count > 1")), ("discounts stay small", l.filter("l_discount > 0.08")))


@query("baseline_predictors", with_facts(PRED + ", m AS (SELECT replicate, intervention, feature, context, value, pred AS m0, avg(value) OVER (PARTITION BY replicate, feature) AS m1, 0.5 * pred + 0.5 * avg(value) OVER (PARTITION BY replicate, feature, context) AS m2 FROM p) SELECT feature, round(avg((value - m0) ** 2), 6) AS mse_m0, round(avg((value - m1) ** 2), 6) AS mse_m1, round(avg((value - m2) ** 2), 6) AS mse_m2 FROM m GROUP BY 1"))
def _(spark, d):
    p = predicted(spark, d).withColumn("m1", F.avg("value").over(Window.partitionBy("replicate", "feature"))).withColumn("m2", F.col("loo") / 2 + F.avg("value").over(Window.partitionBy("replicate", "feature", "context")) / 2)
    mse = lambda c: F.avg((F.col("value") - F.col(c)) * (F.col("value") - F.col(c)))
    return rounded(p.groupBy("feature").agg(mse("loo").alias("mse_m0"), mse("m1").alias("mse_m1"), mse("m2").alias("mse_m2")))


@query("weight_diagnostics", "SELECT label, round(max(abs(w)), 6) AS largest, round(avg((w < 0)::INT), 6) AS negative, round(1 / sum(w * w / (t * t)), 4) AS effective FROM (SELECT label, embedding[1]::DOUBLE AS w, sum(abs(embedding[1]::DOUBLE)) OVER (PARTITION BY label) AS t FROM embeddings) GROUP BY 1")
def _(spark, d):
    w = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("w"))
    w = w.withColumn("t", F.sum(F.abs("w")).over(Window.partitionBy("label")))
    g = w.groupBy("label").agg(F.max(F.abs("w")).alias("largest"), F.avg((F.col("w") < 0).cast("double")).alias("negative"), (1 / F.sum(F.col("w") * F.col("w") / (F.col("t") * F.col("t")))).alias("effective"))
    return rounded(g, "effective").withColumn("effective", r("effective", 4))


@query("adjacent_gains", with_facts(", c AS (SELECT context, feature, sum(value * value) AS q FROM fact GROUP BY ALL), k AS (SELECT context, row_number() OVER (PARTITION BY context ORDER BY feature)::INT AS k, sum(q) OVER (PARTITION BY context ORDER BY feature) / sum(q) OVER (PARTITION BY context) AS ret FROM c) SELECT context, k, round(lead(ret) OVER (PARTITION BY context ORDER BY k) - ret, 6) AS gain, round(1 - ret, 6) AS to_full FROM k"))
def _(spark, d):
    q = facts(spark, d).groupBy("context", "feature").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    w = Window.partitionBy("context")
    k = q.select("context", F.row_number().over(w.orderBy("feature")).alias("k"), (F.sum("q").over(w.orderBy("feature")) / F.sum("q").over(w)).alias("ret"))
    return k.select("context", "k", r(F.lead("ret").over(w.orderBy("k")) - F.col("ret")).alias("gain"), r(1 - F.col("ret")).alias("to_full"))


@query("verdict", with_facts(GAMMA + ENERGY + ", b AS (SELECT context, 1 - sum(e) / sum(s) AS g, sum(s) AS s FROM en GROUP BY 1) SELECT context, CASE WHEN s <= 0 THEN 'no stable signal' WHEN g > 0.5 THEN 'recovered' WHEN g > 0 THEN 'partly recovered' ELSE 'not recovered' END AS verdict FROM b"))
def _(spark, d):
    b = energy(spark, d).groupBy("context").agg(F.sum("s").alias("s"), F.sum("e").alias("e")).withColumn("g", 1 - F.col("e") / F.col("s"))
    return b.select("context", F.when(F.col("s") <= 0, "no stable signal").when(F.col("g") > 0.5, "recovered").when(F.col("g") > 0, "partly recovered").otherwise("not recovered").alias("verdict"))


@query("recoded_classes", "SELECT p_partkey, CASE WHEN p_type LIKE 'S%' THEN 'S' WHEN p_type LIKE 'P%' THEN 'P' ELSE 'other' END AS family, p_size BETWEEN 16 AND 32 AS middle, upper(p_brand) LIKE 'BRAND#1%' AS excluded, abs(p_size - 25) >= 2 * abs(p_size - 10) AS twofold FROM part")
def _(spark, d):
    t = F.col("p_type")
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(t.startswith("S"), "S").when(t.startswith("P"), "P").otherwise("other").alias("family"), s.between(16, 32).alias("middle"), F.upper("p_brand").startswith("BRAND#1").alias("excluded"), (F.abs(s - 25) >= 2 * F.abs(s - 10)).alias("twofold"))


# --- decompositions: tested against NumPy -----------------------------------------------------------


@query("pca_programs")
def _(spark, d):
    return decompose.pca(gamma(spark, d), "feature", "context", "intervention", "gamma", 5)


@query("nmf_programs")
def _(spark, d):
    return decompose.nmf(facts(spark, d), "feature", "context", "intervention", "value", 3)


@query("low_rank_completion")
def _(spark, d):
    f = facts(spark, d).groupBy("feature", "context", "intervention").agg(F.avg("value").alias("value"))
    return decompose.complete_low_rank(f, design.latin_masks(f), 2, 1.0)


@query("linkage_clusters")
def _(spark, d):
    g = interaction.gram_distances(interaction.context_gram(gram(spark, d)), 4)
    return decompose.linkage(g.select(F.lit("all").alias("group"), F.col("ctx_a").alias("a"), F.col("ctx_b").alias("b"), F.col("distance").alias("d")), "group", 3.0)


@query("ridge_leave_one_out")
def _(spark, d):
    f = facts(spark, d).withColumn("name", F.concat_ws("|", "intervention", "feature"))
    names = [x[0] for x in f.select("name").distinct().orderBy("name").collect()]  # an axis of the design
    by = f.groupBy(F.col("context").alias("unit"), "replicate").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    by = by.select("unit", "replicate", F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.col("m")[n], F.lit(0.0))).alias("xs"))
    side = lambda k, name: by.filter(F.col("replicate") == k).select("unit", F.col("xs").alias(name))
    return decompose.ridge_leave_one_out(side(0, "x").join(side(1, "y"), "unit"), [0.1, 1.0, 10.0])


@query("logistic_program")
def _(spark, d):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    folds = e.withColumn("fold", X.hash_fold(F.col("vec_id").cast("string"), 5))
    scored = None
    for k in range(5):
        model = LogisticRegression(maxIter=20, regParam=0.01).fit(folds.filter(F.col("fold") != k))
        own = model.transform(folds.filter(F.col("fold") == k)).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
        scored = own if scored is None else scored.unionByName(own)
    return scored


# --- more metrics, selections, cohorts ---------------------------------------------------------------


@query("partial_spearman", SALES_SQL + """, b AS (SELECT o_custkey, sum(l_quantity) AS x, sum(l_extendedprice) AS y, count(*) AS z FROM sale GROUP BY 1), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY round(y, 2)) + (count(*) OVER (PARTITION BY round(y, 2)) - 1) / 2.0 AS y, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS z FROM b), c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM k) SELECT round((xy - xz * yz) / sqrt((1 - xz ** 2) * (1 - yz ** 2)), 6) AS rho FROM c""")
def _(spark, d):
    b = sales(spark, d).groupBy("o_custkey").agg(F.sum("l_quantity").alias("x"), r(F.sum("l_extendedprice"), 2).alias("y"), F.count(F.lit(1)).alias("z"))
    return rounded(metrics.partial_spearman(b, "x", "y", "z"))


PAIR_DISTANCES = GAMMA + ", dd AS (SELECT a.context AS a, b.context AS b, round(sum((a.gamma - b.gamma) ** 2) FILTER (a.replicate = 0), 6) AS da, round(sum((a.gamma - b.gamma) ** 2) FILTER (a.replicate = 1), 6) AS db FROM gam a JOIN gam b ON a.replicate = b.replicate AND a.intervention = b.intervention AND a.feature = b.feature AND a.context < b.context GROUP BY ALL)"


@query("geometry_reliability", with_facts(PAIR_DISTANCES + """, k AS (SELECT *, rank() OVER (ORDER BY da) AS ra, rank() OVER (ORDER BY db) AS rb FROM dd), s AS (SELECT a AS u, b AS v, da, db FROM dd UNION ALL SELECT b, a, da, db FROM dd), n AS (SELECT u, row_number() OVER (PARTITION BY u ORDER BY da, v) AS ka, row_number() OVER (PARTITION BY u ORDER BY db, v) AS kb FROM s), o AS (SELECT u, count(*) FILTER (ka <= 3 AND kb <= 3) / 3 AS o, max((ka = 1 AND kb = 1)::INT) AS one FROM n GROUP BY 1)
SELECT (SELECT round(corr(ra, rb), 6) FROM k) AS spearman, (SELECT round(corr(da, db), 6) FROM k) AS pearson, round(avg(o), 6) AS knn_overlap, round(avg(one), 6) AS nearest_agreement FROM o"""))
def _(spark, d):
    g = gamma(spark, d)
    a, b = (g.select("replicate", "intervention", "feature", F.col("context").alias(k), F.col("gamma").alias(f"g{k}")) for k in "ab")
    sq = (F.col("ga") - F.col("gb")) * (F.col("ga") - F.col("gb"))
    p = a.join(b, ["replicate", "intervention", "feature"]).filter("a < b").groupBy("a", "b").agg(r(F.sum(F.when(F.col("replicate") == 0, sq))).alias("da"), r(F.sum(F.when(F.col("replicate") == 1, sq))).alias("db"))
    return rounded(metrics.geometry_reliability(p, 3))


@query("support_table", "SELECT label, count(*) FILTER (w <> 0) AS support, count(*) FILTER (w > 0) AS up, count(*) FILTER (w < 0) AS down, round(sum(abs(w)), 4) AS l1, round(sqrt(sum(w * w)), 4) AS l2 FROM (SELECT label, unnest(embedding)::DOUBLE AS w FROM embeddings) GROUP BY 1")
def _(spark, d):
    w = table(spark, d, "embeddings").select("label", F.explode(F.transform("embedding", lambda x: x.cast("double"))).alias("weight"))
    return rounded(metrics.support_table(w, "label"), digits=4)


@query("dominated_rows", "WITH s AS (SELECT p_brand AS brand, count(*)::DOUBLE AS x, round(avg(p_retailprice), 6) AS y FROM part GROUP BY 1) SELECT brand FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.x >= a.x - 0.5 AND b.y >= a.y - 0.5 AND (b.x > a.x + 0.5 OR b.y > a.y + 0.5))")
def _(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).cast("double").alias("x"), r(F.avg("p_retailprice")).alias("y"))
    return metrics.dominated(s, "brand", "x", "y", 0.5)


CURVES = "WITH p AS (SELECT c_mktsegment AS curve, k::DOUBLE AS x, round(avg(c_acctbal) FILTER (c_custkey % 10 < k), 4) AS y FROM customer, range(2, 10) t(k) GROUP BY ALL)"


def curves(spark, d):
    c = table(spark, d, "customer").withColumn("x", F.explode(F.sequence(F.lit(2), F.lit(9)))).filter(F.col("c_custkey") % 10 < F.col("x"))
    return c.groupBy(F.col("c_mktsegment").alias("curve"), F.col("x").cast("double").alias("x")).agg(r(F.avg("c_acctbal"), 4).alias("y"))


POWER = CURVES + """, z AS (SELECT curve, rate, y, x ** -rate AS z FROM p, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) v(rate)), f AS (SELECT curve, rate, count(*) AS n, regr_intercept(y, z) AS a, regr_slope(y, z) AS b, regr_syy(y, z) AS syy, greatest(regr_syy(y, z) - regr_slope(y, z) * regr_sxy(y, z), 1e-12) AS sse FROM z GROUP BY ALL),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY curve ORDER BY sse, rate) = 1), s AS (SELECT curve, rate, a, b, n * ln(sse / n) + 8 + 40.0 / (n - 5) AS aicc_power, n * ln(greatest(syy, 1e-12) / n) + 4 + 12.0 / (n - 3) AS aicc_constant FROM b)"""


@query("power_fit", POWER + " SELECT curve, rate, round(a, 3) AS a, round(b, 3) AS b, round(aicc_power, 4) AS aicc_power, round(aicc_constant, 4) AS aicc_constant, CASE WHEN aicc_power < aicc_constant THEN 'power' ELSE 'constant' END AS model FROM s")
def _(spark, d):
    f = models.power_fit(curves(spark, d), "curve", "x", "y", [0.5, 1.0])
    return f.withColumns({"a": r("a", 3), "b": r("b", 3), "aicc_power": r("aicc_power", 4), "aicc_constant": r("aicc_constant", 4)})


@query("contexts_for_target", POWER + " SELECT curve, round(CASE WHEN (4600 - a) / b > 0 THEN ((4600 - a) / b) ** (-1 / rate) END, 3) AS needed FROM s")
def _(spark, d):
    return rounded(models.contexts_for_target(models.power_fit(curves(spark, d), "curve", "x", "y", [0.5, 1.0]), "curve", 4600.0), digits=3)


@query("prediction_sets", PROB + """, s AS (SELECT doc_id, quality, p, doc_id % 2 = 0 AS cal FROM l), sc AS (SELECT quality AS label, 1 - CASE WHEN quality = 1 THEN p ELSE 1 - p END AS score FROM s WHERE cal), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score) AS i, ceil((count(*) OVER (PARTITION BY label) + 1) * (1 - 0.2)) AS need FROM sc), c AS (SELECT label, coalesce(min(score) FILTER (i = need), 'inf'::DOUBLE) AS cut FROM k GROUP BY 1),
t AS (SELECT quality, p <= (SELECT cut FROM c WHERE label = 0) + 1e-12 AS in0, 1 - p <= (SELECT cut FROM c WHERE label = 1) + 1e-12 AS in1 FROM s WHERE NOT cal), u AS (SELECT quality, in0 OR NOT (in0 OR in1) AS in0, in1 OR NOT (in0 OR in1) AS in1 FROM t)
SELECT round(avg(in0::INT + in1::INT), 6) AS size, round(avg(CASE WHEN quality = 1 THEN in1 ELSE in0 END::INT), 6) AS covered, round(avg((in0 <> in1)::INT), 6) AS singleton FROM u""")
def _(spark, d):
    p = probabilities(spark, d).withColumn("label", F.col("quality").cast("int")).withColumn("score", 1 - F.when(F.col("quality") == 1, F.col("p")).otherwise(1 - F.col("p")))
    cuts = models.conformal_cut(p.filter("doc_id % 2 = 0"), ["label"], "score", 0.2)
    sets = models.prediction_sets(p.filter("doc_id % 2 <> 0").withColumn("probs", F.array(1 - F.col("p"), F.col("p"))), cuts, "probs")
    return rounded(models.set_quality(sets, "quality"))


@query("feature_flags", "SELECT p_brand, round(avg(p_retailprice), 4) AS mean, round(var_pop(p_retailprice), 2) AS variance, bool_or(p_size = 50) AS is_target, p_brand LIKE 'Brand#2%' AS is_technical, var_pop(p_retailprice) <= 1e-12 AS is_flat, NOT (bool_or(p_size = 50) OR p_brand LIKE 'Brand#2%' OR var_pop(p_retailprice) <= 1e-12) AS eligible FROM part GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part")
    f = cohort.feature_flags(p, "p_brand", "p_retailprice", p.filter("p_size = 50"), ("brand#2",))
    return f.withColumns({"mean": r("mean", 4), "variance": r("variance", 2)})


@query("pairing", "SELECT user_id, a AS n_first, b AS n_second, CASE WHEN a = 1 AND b = 1 THEN 'paired' WHEN a > 0 AND b > 0 THEN 'replicated' WHEN a > 0 THEN 'first_only' WHEN b > 0 THEN 'second_only' ELSE 'neither' END AS pairing FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1)")
def _(spark, d):
    return cohort.pairing(table(spark, d, "events"), "user_id", "event_type", "click", "purchase")


@query("one_of_each", "SELECT user_id, event_type, arg_min(event_id, (sha256('one|' || user_id || '|' || event_type || '|' || event_id), event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    return cohort.one_of_each(table(spark, d, "events"), ["user_id", "event_type"], "event_id", "one")


@query("missingness", '''SELECT o_orderstatus, "column", sum(there)::BIGINT AS present, (count(*) - sum(there))::BIGINT AS missing, round(avg(there), 6) AS share FROM (SELECT o_orderstatus, unnest(['big', 'urgent']) AS "column", unnest([(o_totalprice > 200000)::INT, (o_orderpriority LIKE '1%')::INT]) AS there FROM orders) GROUP BY ALL''')
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_totalprice") > 200000, 1).alias("big"), F.when(F.col("o_orderpriority").startswith("1"), 1).alias("urgent"))
    return rounded(cohort.missingness(o, "o_orderstatus", ["big", "urgent"]))


@query("gram_without_fold", with_facts(", fo AS (SELECT intervention, ((row_number() OVER (ORDER BY sha256('fg|' || intervention)) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT intervention FROM fact)) SELECT h.fold AS hidden, a.context AS ctx_a, b.context AS ctx_b, round(sum(a.value * b.value) - sum(a.value) * sum(b.value) / count(*), 3) AS dot FROM (SELECT DISTINCT fold FROM fo) h, fact a JOIN fact b USING (replicate, intervention, feature) JOIN fo ON fo.intervention = a.intervention WHERE fo.fold <> h.fold GROUP BY ALL", "r_name"))
def _(spark, d):
    f = facts(spark, d, "r_name")
    return rounded(signal.gram_without(signal.fold_gram(f, design.stride_folds(f, "intervention", "fg"))), digits=3)


@query("shared_and_specific", with_facts(PRED + ", s AS (SELECT context, sum(value * pred) AS vl, sum(pred * pred) AS ll, sum(value * value) AS vv FROM p GROUP BY 1) SELECT context, round(vl / ll, 6) AS beta, round(vl / ll * vl, 3) AS shared, round(vv - vl / ll * vl, 3) AS specific FROM s"))
def _(spark, d):
    s = signal.shared_and_specific(facts(spark, d))
    return s.select("context", r("beta").alias("beta"), r("shared", 3).alias("shared"), r("specific", 3).alias("specific"))


@query("matched_selection", "WITH s AS (SELECT p_brand AS brand, round(avg(p_retailprice), 4) AS v FROM part GROUP BY 1) SELECT brand, partner, rank FROM (SELECT a.brand, b.brand AS partner, row_number() OVER (PARTITION BY a.brand ORDER BY round(abs(a.v - b.v), 6), b.brand)::INT AS rank FROM s a JOIN s b ON a.brand <> b.brand) WHERE rank <= 2")
def _(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(r(F.avg("p_retailprice"), 4).alias("v"))
    return signal.matched(s, s, "brand", "v", 2)


@query("penalty_selection")
def _(spark, d):
    from ..operators import sealed

    g = gamma(spark, d).select("replicate", "context", "intervention", "feature", F.col("gamma").alias("value"))
    return models.select_penalty(sealed.by_fold(g, design.stride_folds(g, "intervention", "ps")), [0.01, 0.1, 1.0, 10.0])


@query("retention", with_facts(", c AS (SELECT context, feature, sum(value * value) AS q FROM fact GROUP BY ALL) SELECT c.context, c.feature, CASE WHEN f.q > 0 THEN round(c.q / f.q, 6) END AS retention FROM c JOIN c f ON f.context = c.context AND f.feature = 'price'"))
def _(spark, d):
    c = facts(spark, d).groupBy("context", "feature").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    return rounded(inference.retention(c, ["context"], "feature", "q", "price"))


@query("selection_coherence", "WITH n AS (SELECT p_brand, p_size % 5 AS k, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_brand, arg_min(k, (-n, k)) AS mode, max(n) / sum(n) AS share FROM n GROUP BY 1), q AS (SELECT p_brand, quantile_cont(p_size % 5, 0.75) - quantile_cont(p_size % 5, 0.25) AS iqr FROM part GROUP BY 1) SELECT p_brand, mode, round(share, 6) AS share, round(iqr, 6) AS iqr, share >= 0.22 AND iqr <= 2 AS coherent FROM m JOIN q USING (p_brand)")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", (F.col("p_size") % 5).alias("k"))
    return rounded(inference.selection_coherence(p, ["p_brand"], "k", 0.22, 2.0))


@query("unit_metric_draws", SALES_SQL + """, m AS (SELECT r_name, avg(l_quantity) AS q, avg(l_discount) AS v FROM sale GROUP BY 1), ax AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i, count(*) OVER () AS n FROM m), pk AS (SELECT d.draw, floor((('0x' || substr(sha256('um|' || d.draw || '|' || ax.i), 1, 13))::BIGINT / 4503599627370496.0) * ax.n)::INT AS i FROM ax, range(50) d(draw))
SELECT draw::INT AS draw, round(avg(q), 6) AS q, round(avg(v), 6) AS v FROM pk JOIN ax USING (i) JOIN m USING (r_name) GROUP BY 1""")
def _(spark, d):
    m = sales(spark, d).groupBy("r_name").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("v"))
    return rounded(inference.unit_metric_draws(inference.unit_draws(m, "r_name", 50, "um"), m, "r_name", ["q", "v"]))


@query("benchmark_targets", "SELECT n_name, i::INT AS place FROM (SELECT n_name, row_number() OVER (ORDER BY sha256('bt|' || n_name)) - 1 AS i, count(*) OVER () AS n FROM nation) WHERE i IN (0, n // 3, 2 * n // 3, n - 1)")
def _(spark, d):
    return design.benchmark_targets(table(spark, d, "nation"), "n_name", "bt")


@query("two_versions", SALES_SQL + ", h AS (SELECT n_name, p_type, count(DISTINCT l_returnflag) AS have FROM sale GROUP BY ALL), k AS (SELECT n_name, count(DISTINCT l_returnflag) AS kinds FROM sale GROUP BY 1), v AS (SELECT n_name, list(p_type ORDER BY p_type) AS vs FROM h JOIN k USING (n_name) WHERE have = kinds GROUP BY 1) SELECT n_name, vs[1] AS version_a, vs[2] AS version_b FROM v WHERE len(vs) >= 2")
def _(spark, d):
    return design.two_versions(sales(spark, d), "n_name", "l_returnflag", "p_type")


@query("cross_replicate_contributions", with_facts(GAMMA + " SELECT a.feature, round(avg(a.gamma * b.gamma), 6) AS stable, round(avg((a.gamma ** 2 + b.gamma ** 2) / 2), 6) AS observed FROM gam a JOIN gam b USING (context, intervention, feature) WHERE a.replicate = 0 AND b.replicate = 1 GROUP BY 1"))
def _(spark, d):
    x = interaction.cross_replicate(gamma(spark, d), "gamma")
    a, b = F.col("gamma0"), F.col("gamma1")
    return rounded(x.groupBy("feature").agg(F.avg(a * b).alias("stable"), F.avg((a * a + b * b) / 2).alias("observed")))


@query("low_rank_weights")
def _(spark, d):
    return models.fit_affine(interaction.context_gram(gram(spark, d)), 0.1, rank=3)


@query("ridge_by_intervention")
def _(spark, d):
    f = facts(spark, d)
    h = f.groupBy("context").pivot("feature", sorted(measures())).avg("value").select("context", F.array(*sorted(measures())).alias("h"))
    y = f.groupBy("context", F.concat_ws("|", "intervention", "feature").alias("intervention")).agg(F.avg("value").alias("value"))
    return models.ridge_by_intervention(y, h, 1.0)


from . import controls, deep, more  # noqa: E402, F401  register their queries here


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

