"""Freezing cohorts and designs: eligibility, complete cores, axis audits, mapping gates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio


def support_mask(df: DataFrame, feature: str, s: str, e: str, training: Column) -> DataFrame:
    """Features that training rows retain: sum of (s - e) above 0. Nothing else is read."""
    return df.filter(training).groupBy(feature).agg(F.sum(F.col(s) - F.col(e)).alias("retained")).filter("retained > 0").select(feature)


def top_variance(df: DataFrame, feature: str, place: str, value: str, k: int) -> DataFrame:
    """The k features of the largest variance, ties to the later place: features are numbered by (variance, place), the last k stay."""
    v = df.groupBy(feature, place).agg(F.round(F.var_pop(value), 9).alias("variance"))
    return v.orderBy(F.col("variance").desc(), F.col(place).desc()).limit(k).select(feature, "variance")


def core_candidates(df: DataFrame, context: str, intervention: str, least: list[int]) -> DataFrame:
    """For each least number of rows a cell: contexts, interventions and cells of the core in which every context has every intervention, best first.

    A context is in the core if it has all interventions that at least half of the contexts have.
    """
    cell = df.groupBy(context, intervention).agg(F.count(F.lit(1)).alias("n"))
    cell = cell.withColumn("least", F.explode(F.array(*map(F.lit, least)))).filter("n >= least")
    contexts = cell.groupBy("least").agg(F.count_distinct(context).alias("contexts"))
    common = cell.groupBy("least", intervention).agg(F.count(F.lit(1)).alias("have")).join(contexts, "least").filter("2 * have >= contexts").select("least", intervention)
    want = common.groupBy("least").agg(F.count(F.lit(1)).alias("interventions"))
    have = cell.join(common, ["least", intervention]).groupBy("least", context).agg(F.count(F.lit(1)).alias("have"), F.min("n").alias("fewest"))
    core = have.join(want, "least").filter("have = interventions").groupBy("least", "interventions").agg(F.count(F.lit(1)).alias("contexts"), F.min("fewest").alias("fewest"))
    order = Window.orderBy(F.col("contexts").desc(), F.col("interventions").desc(), F.col("fewest").desc(), "least")  # a row a candidate
    return core.withColumn("place", F.row_number().over(order)).withColumn("passed", (F.col("contexts") >= 2) & (F.col("interventions") >= 2)).select("place", "least", "contexts", "interventions", "fewest", "passed")


def frozen_cohort(df: DataFrame, unit: str, state: str, control: Column, value: str, low: float, high: float) -> DataFrame:
    """Units that have every state, a control in every state, and a row count within the low and high quantiles of all units' counts; with their order by name."""
    states = df.agg(F.count_distinct(state).alias("states"))  # one row
    each = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(state).alias("have"), F.count_distinct(F.when(control, F.col(state))).alias("controls"), F.avg(F.when(~control, F.col(value))).alias("mean"))
    band = each.agg(F.percentile("n", F.array(F.lit(low), F.lit(high))).alias("q"))
    ok = each.join(F.broadcast(states)).join(F.broadcast(band)).filter((F.col("have") == F.col("states")) & (F.col("controls") == F.col("states")) & F.col("n").between(F.col("q")[0], F.col("q")[1]))
    return ok.withColumn("place", F.row_number().over(Window.orderBy(unit))).select(unit, "place", "n", "mean")


def replicate_core(df: DataFrame, unit: str, replicate: str, least: int) -> DataFrame:
    """Units with at least so many rows in every replicate, by coverage only: no value is read."""
    kinds = df.agg(F.count_distinct(replicate).alias("kinds"))
    each = df.groupBy(unit, replicate).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).groupBy(unit).agg(F.count(F.lit(1)).alias("have"), F.min("n").alias("fewest"))
    return each.join(F.broadcast(kinds), F.col("have") == F.col("kinds")).select(unit, "fewest")


def domain_split(df: DataFrame, unit: str, domain: str) -> DataFrame:
    """held, unit, role: each domain held out whole; its units are tests, those of all others train."""
    u = df.select(unit, domain).distinct()
    held = u.select(F.col(domain).alias("held")).distinct()
    return held.join(u, F.lit(True)).select("held", unit, F.when(F.col(domain) == F.col("held"), "outer_test").otherwise("outer_train").alias("role"))


def axis_audit(df: DataFrame, by: list[str], axes: list[str], value: str) -> DataFrame:
    """by -> rows, distinct entries of every axis, missing values, span of the values, and whether the block is complete."""
    full = reduce(lambda a, b: a * b, (F.count_distinct(a) for a in axes))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_distinct(a).alias(f"n_{a}") for a in axes), F.count_if(F.col(value).isNull()).alias("missing"), (F.max(value) - F.min(value)).alias("span"), (F.count(F.lit(1)) == full).alias("complete")
    )


def mapping_check(a: DataFrame, b: DataFrame, c: DataFrame, key: str, name: str) -> DataFrame:
    """key of three sources that don't all agree on one name (or lack it); none: the mapping holds."""
    side = lambda x, k: x.groupBy(key).agg(F.min(name).alias(k), F.count_distinct(name).alias(f"n_{k}"))
    all_ = side(a, "a").join(side(b, "b"), key, "full").join(side(c, "c"), key, "full")
    same = (F.col("a") == F.col("b")) & (F.col("b") == F.col("c")) & (F.col("n_a") == 1) & (F.col("n_b") == 1) & (F.col("n_c") == 1)
    return all_.filter(~F.coalesce(same, F.lit(False))).select(key, "a", "b", "c")


def positional_link(left: DataFrame, right: DataFrame, position: str, index: str, columns: list[str], tolerance: float) -> DataFrame:
    """Rows of left linked to right by a 1-based position, and whether all columns are equal there (null with null) within the tolerance."""
    r_ = right.select(F.col(index).alias("__i"), *(F.col(c).alias(f"__{c}") for c in columns))
    both = left.join(r_, F.col(position) - 1 == F.col("__i"), "left")
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance, F.col(c).isNull() & F.col(f"__{c}").isNull())
    return both.withColumn("verified", F.col("__i").isNotNull() & reduce(lambda x, y: x & y, map(near, columns))).drop("__i", *(f"__{c}" for c in columns))


def dense_rows(df: DataFrame, row: str, column: str, value: str, share: float = 0.95) -> DataFrame:
    """Every column of every row that has at least the share of columns; what is missing or not a number is 0."""
    axis = df.select(column).distinct()
    n = axis.agg(F.count(F.lit(1)).alias("all"))
    good = F.col(value).isNotNull() & ~F.isnan(value)
    keep = df.filter(good).groupBy(row).agg(F.count_distinct(column).alias("have")).join(F.broadcast(n)).filter(F.col("have") >= share * F.col("all")).select(row)
    full = keep.join(axis, F.lit(True))  # kept rows times columns: the dense result itself
    return full.join(df.filter(good).select(row, column, value), [row, column], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def first_block(df: DataFrame, order: str, block: str, feature: str) -> DataFrame:
    """The features of the block that comes first by an explicit order column, numbered by their own order there."""
    first = df.agg(F.min_by(block, order).alias("__b"))
    rows = df.join(F.broadcast(first), F.col(block) == F.col("__b")).groupBy(feature).agg(F.min(order).alias("__o"))
    return rows.select(feature, F.row_number().over(Window.orderBy("__o")).alias("place"))  # one block's features


def entropy(df: DataFrame, by: list[str], weight: str) -> DataFrame:
    """by -> entropy of absolute weights as shares."""
    s = df.groupBy(*by).agg(F.sum(F.abs(weight)).alias("__t"))
    p = F.abs(weight) / F.col("__t")
    return df.join(s, by).groupBy(*by).agg((-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"))


def edge_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """df with bin: how many of the interior quantile edges lie below the value (a value on an edge belongs to the bin that it ends). Edges are exact, from ranges of values."""
    from .ranks import quantiles

    q = quantiles(df.select(F.lit(1).alias("__one"), value), ["__one"], value, [k / bins for k in range(1, bins)])
    edges = q.agg(F.sort_array(F.collect_list("q")).alias("__e"))
    return df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col(value)))).drop("__e")  # one row of bins - 1 edges


def generated(units: DataFrame, unit: str, signal: Column, share: float, seed: str) -> DataFrame:
    """units with generated: a semi-synthetic value, sqrt(share) of the signal and sqrt(1 - share) of unit Gaussian noise that the unit's hash fixes."""
    from ..functions.expr import hash_uniform

    u, v = (hash_uniform(F.lit(f"{seed}{k}"), F.col(unit)) for k in "uv")
    noise = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
    return units.withColumn("generated", F.sqrt(F.lit(share)) * signal + F.sqrt(F.lit(1 - share)) * noise)


def program_match(df: DataFrame, program: str, version: str, item: list[str], weight: str, first, second) -> DataFrame:
    """program of the first version -> the program of the second with the largest absolute correlation of weights, ties to the smaller name."""
    a, b = (df.filter(F.col(version) == v).select(*item, F.col(program).alias(k), F.col(weight).alias(f"w{k}")) for v, k in ((first, "a"), (second, "b")))
    c = a.join(b, item).groupBy("a", "b").agg(F.round(F.corr("wa", "wb"), 9).alias("r"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.abs("r").desc(), "b"))  # programs of an axis
    return c.withColumn("__k", best).filter("__k = 1").select(F.col("a").alias("program"), F.col("b").alias("match"), "r")


def pooled_r2(df: DataFrame, feature: str, truth: str, prediction: str, thresholds: list[float]) -> DataFrame:
    """R2 over all cells, mean R2 by feature, and the share of features above each threshold."""
    d = F.col(truth) - F.col(prediction)
    f = df.groupBy(feature).agg(F.sum(d * d).alias("sse"), (F.var_pop(truth) * F.count(truth)).alias("sst"))
    r2 = 1 - safe_ratio(F.col("sse"), F.col("sst"))
    return f.agg((1 - safe_ratio(F.sum("sse"), F.sum("sst"))).alias("pooled"), F.avg(r2).alias("mean"), *(F.avg((r2 > t).cast("double")).alias(f"above_{str(t).replace('.', '_')}") for t in thresholds))


def coordinates(df: DataFrame, axis: str, truth: str, prediction: str, energy: str) -> DataFrame:
    """axis -> R2, sign agreement and variance ratio of predicted coordinates; and over all of them weighted by training energy (axis null)."""
    d = F.col(truth) - F.col(prediction)
    each = df.groupBy(axis).agg(
        (1 - safe_ratio(F.sum(d * d), F.var_pop(truth) * F.count(truth))).alias("r2"), F.avg((F.signum(truth) == F.signum(prediction)).cast("double")).alias("same_sign"), safe_ratio(F.var_pop(prediction), F.var_pop(truth)).alias("variance_ratio"), F.sum(energy).alias("energy")
    )
    whole = each.agg(*(safe_ratio(F.sum(F.col(c) * F.col("energy")), F.sum("energy")).alias(c) for c in ("r2", "same_sign", "variance_ratio")), F.sum("energy").alias("energy"))
    return each.unionByName(whole.select(F.lit(None).cast(dict(df.dtypes)[axis]).alias(axis), "r2", "same_sign", "variance_ratio", "energy"))


def gate_classes(df: DataFrame, unit: str, amplitude: list[Column], relation: list[Column], least: int) -> DataFrame:
    """unit -> amplitude and relational gates passed, and the class that they make."""
    count = lambda gates: reduce(lambda x, y: x + y, (F.coalesce(g, F.lit(False)).cast("int") for g in gates))
    d = df.select(unit, count(amplitude).alias("amplitude"), count(relation).alias("relation"))
    a, b = F.col("amplitude") >= least, F.col("relation") >= least
    return d.withColumn("class", F.when(a & b, "both").when(a, "amplitude").when(b, "relational").otherwise("neither"))


def scaling_laws(points: DataFrame, curve: str, x: str, y: str, rates: list[float]) -> DataFrame:
    """curve -> error, AICc and leave-one-out error of the constant, logarithmic, power (with floor) and exponential laws, and which is chosen.

    Each law is linear in a transform of x, so that least squares are sums; rates come from a grid. A point that is left out has
    the error e / (1 - h) and takes e^2 / (1 - h) out of a rate's sum of squares, so that the rate is chosen anew without it and
    nothing is fitted twice. Points have levels x of their own. Chosen: the least leave-one-out error, then AICc.
    """
    p = points.select(F.col(curve).alias("c"), F.col(x).alias("x"), F.col(y).alias("y"))
    grid = F.explode(F.array(*map(F.lit, rates)))
    one = p.withColumn("law", F.lit("constant")).withColumn("rate", F.lit(0.0)).withColumn("z", F.lit(0.0))
    log = p.withColumn("law", F.lit("logarithm")).withColumn("rate", F.lit(0.0)).withColumn("z", F.log("x"))
    power = p.withColumn("law", F.lit("power")).withColumn("rate", grid).withColumn("z", F.pow("x", -F.col("rate")))
    decay = p.withColumn("law", F.lit("exponential")).withColumn("rate", grid).withColumn("z", F.exp(-F.col("rate") * F.col("x")))
    all_ = one.unionByName(log).unionByName(power).unionByName(decay)
    fit = all_.groupBy("c", "law", "rate").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mz"), F.avg("y").alias("my"), (F.var_pop("z") * F.count("z")).alias("szz"), (F.covar_pop("z", "y") * F.count("z")).alias("szy"))
    fit = fit.withColumn("b", F.when(F.col("szz") > 1e-12, F.col("szy") / F.col("szz")).otherwise(0.0))
    e = F.col("y") - F.col("my") - F.col("b") * (F.col("z") - F.col("mz"))
    h = 1 / F.col("n") + F.when(F.col("szz") > 1e-12, (F.col("z") - F.col("mz")) * (F.col("z") - F.col("mz")) / F.col("szz")).otherwise(0.0)
    k = F.when(F.col("law") == "constant", 2).when(F.col("law") == "logarithm", 3).otherwise(4)
    rows = all_.join(fit, ["c", "law", "rate"]).withColumn("e", e).withColumn("left", F.greatest(1 - h, F.lit(1e-9)))
    s = rows.groupBy("c", "law", "rate", "n").agg(F.greatest(F.sum(F.col("e") * F.col("e")), F.lit(1e-12)).alias("sse"))
    without = rows.join(s.select("c", "law", "rate", "sse"), ["c", "law", "rate"]).withColumn("rest", F.round(F.col("sse") - F.col("e") * F.col("e") / F.col("left"), 9))
    out = without.groupBy("c", "law", "x").agg(F.min_by(F.col("e") / F.col("left"), F.struct("rest", "rate")).alias("o"))
    s = s.join(out.groupBy("c", "law").agg(F.sqrt(F.avg(F.col("o") * F.col("o"))).alias("loo")), ["c", "law"])
    s = s.withColumn("aicc", F.col("n") * F.log(F.col("sse") / F.col("n")) + 2 * k + 2 * k * (k + 1) / F.greatest(F.col("n") - k - 1, F.lit(1)))
    best = s.withColumn("__k", F.row_number().over(Window.partitionBy("c", "law").orderBy(F.round("sse", 9), "rate"))).filter("__k = 1")  # the rates of a grid
    pick = F.row_number().over(Window.partitionBy("c").orderBy(F.round("loo", 9), F.round("aicc", 9), "law")) == 1
    return best.select(F.col("c").alias(curve), "law", "rate", "sse", "loo", "aicc", pick.alias("chosen"))


def semi_synthetic(rows: DataFrame, rank: int, share: float, reliability: float, seed: int = 0) -> DataFrame:
    """id, a, b: two replicates of responses made from rows(id bigint, x array<double>).

    Standardised rows on rank random orthonormal axes, each score standardised, make sqrt(share) of the components, Gaussian numbers
    of the row's own seed the rest; random orthonormal response axes turn them into a signal of as many features. Each replicate
    adds Gaussian noise whose variance gives the replicates' correlation the target reliability. Means, deviations and the signal's
    variance are sums over all rows; no row leaves its task.
    """
    from .subspace import stacked, summed

    def moments(make) -> tuple[np.ndarray, np.ndarray]:
        m = summed(rows, lambda x: np.vstack([make(x).sum(0), (make(x) ** 2).sum(0), np.full(make(x).shape[1], len(x))]))
        mean = m[0] / m[2]
        return mean, np.maximum(np.sqrt(np.maximum(m[1] / m[2] - mean**2, 0)), 1e-12)

    mean, scale = moments(lambda x: x)
    p = len(mean)
    axes, back = (np.linalg.qr(np.random.default_rng([seed, k]).normal(size=(p, rank)))[0] for k in (1, 2))
    raw = lambda x: ((x - mean) / scale) @ axes
    at, spread = moments(raw)

    def components(ids, x):
        own = np.stack([np.random.default_rng([seed, 3, int(i) % 2**63]).normal(size=rank) for i in ids]) if len(x) else np.zeros((0, rank))
        return np.sqrt(share) * (raw(x) - at) / spread + np.sqrt(1 - share) * own

    keyed = rows.select("id", "x")

    def signal(batches):
        for batch in batches:
            s = components(batch.column(0).to_pylist(), stacked(batch.column(1))) @ back.T if batch.num_rows else np.zeros((0, p))
            yield pa.RecordBatch.from_arrays([pa.array([float(s.sum())]), pa.array([float((s**2).sum())]), pa.array([s.size])], ["s", "q", "n"])

    t = keyed.mapInArrow(signal, "s double, q double, n bigint").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).first()
    sigma = float(np.sqrt(max(t.q / t.n - (t.s / t.n) ** 2, 0) * (1 - reliability) / reliability))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            x = stacked(batch.column(1)) if ids else np.zeros((0, p))
            s = components(ids, x) @ back.T
            out = [s + sigma * np.stack([np.random.default_rng([seed, k, int(i) % 2**63]).normal(size=p) for i in ids]) if ids else s for k in (4, 5)]
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * p)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(o.ravel())) for o in out)], ["id", "a", "b"])

    return keyed.mapInArrow(run, "id bigint, a array<double>, b array<double>")
