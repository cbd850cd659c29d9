"""Exact permutation nulls from cross-Grams: responses are read once, for the products of items.

A statistic of donor halves is a signed sum of products between units (a donor in a state)
of one item; under a permutation each unit shows another item. So the null needs nothing but
the products of any item of one unit with any item of another, the plan of terms that make
up a statistic, and the permutations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nulls import permutation

UNIT = ["donor", "state"]


def halves(units: DataFrame) -> DataFrame:
    """partition, donor, side: every way to part an even number of donors into two equal sides, once each. Donors are few (12 at most)."""
    donors = units.select("donor").distinct()
    n = donors.count()
    if n % 2 or n > 12:
        raise ValueError(f"{n} donors can't be parted into halves here")
    axis = sorted(r[0] for r in donors.collect())
    rows, kept = [], 0
    for mask in range(1 << n):
        if bin(mask).count("1") == n // 2 and mask & 1:  # the first donor is always on the left
            rows += [(kept, d, (mask >> k) & 1 ^ 1) for k, d in enumerate(axis)]
            kept += 1
    return units.sparkSession.createDataFrame(rows, f"partition int, donor {units.schema['donor'].dataType.simpleString()}, side int")


def term_plan(units: DataFrame) -> DataFrame:
    """partition, state_a, state_b, then the unit on either side of a product (donor_l, state_l, donor_r, state_r, in order) and its coefficient.

    The statistic of a partition and two states is the product of both sides' mean difference between the states. Equal products of a statistic are one term.
    """
    states = units.select("state").distinct()
    contrast = states.select(F.col("state").alias("state_a")).join(states.select(F.col("state").alias("state_b")), F.col("state_a") < F.col("state_b"))
    sign = F.inline(F.array(F.struct(F.col("state_a").alias("state"), F.lit(1.0).alias("sign")), F.struct(F.col("state_b").alias("state"), F.lit(-1.0).alias("sign"))))
    part = halves(units)
    size = part.filter("side = 0").groupBy("partition").agg(F.count(F.lit(1)).alias("half"))
    member = part.join(size, "partition").join(contrast).select("partition", "state_a", "state_b", "donor", "side", "half", sign)
    side = lambda k, n: member.filter(F.col("side") == k).select("partition", "state_a", "state_b", F.struct("donor", "state").alias(f"u{n}"), (F.col("sign") / F.col("half")).alias(f"c{n}"))
    both = side(0, "l").join(side(1, "r"), ["partition", "state_a", "state_b"])
    low, high = F.least("ul", "ur"), F.greatest("ul", "ur")
    terms = both.groupBy("partition", "state_a", "state_b", low.alias("l"), high.alias("r")).agg(F.sum(F.col("cl") * F.col("cr")).alias("coefficient"))
    return terms.select("partition", "state_a", "state_b", F.col("l.donor").alias("donor_l"), F.col("l.state").alias("state_l"), F.col("r.donor").alias("donor_r"), F.col("r.state").alias("state_r"), "coefficient")


def centred(df: DataFrame) -> DataFrame:
    """df(donor, state, item, feature, value) with the mean over items taken out of each unit and feature."""
    mean = df.groupBy(*UNIT, "feature").agg(F.avg("value").alias("__m"))
    return df.join(mean, [*UNIT, "feature"]).withColumn("value", F.col("value") - F.col("__m")).drop("__m")


def cross_grams(df: DataFrame, plan: DataFrame) -> DataFrame:
    """donor_l, state_l, item_l, donor_r, state_r, item_r, dot of the pairs of units that the plan needs. Items are an axis of the design; features are packed before the join."""
    packed = df.groupBy(*UNIT, "item").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("xs"))
    side = lambda k: packed.select(F.col("donor").alias(f"donor_{k}"), F.col("state").alias(f"state_{k}"), F.col("item").alias(f"item_{k}"), F.col("xs").alias(f"x{k}"))
    pairs = plan.select("donor_l", "state_l", "donor_r", "state_r").distinct()
    dot = F.aggregate(F.zip_with("xl", "xr", lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    both = pairs.join(side("l"), ["donor_l", "state_l"]).join(side("r"), ["donor_r", "state_r"])
    return both.select("donor_l", "state_l", "item_l", "donor_r", "state_r", "item_r", dot.alias("dot"))


def unit_permutations(df: DataFrame, draws: int, seed: str, block: list[str] | None = None) -> DataFrame:
    """draw, donor, state, place, item: in each draw every unit's items in an order of its own, inside blocks (columns of df that an item has) where there are any; draw -1 is as observed."""
    own = df.select(*UNIT, "item", *(block or [])).distinct()
    moved = permutation(own, "item", draws, seed, [*UNIT, *(block or [])]).select("draw", *UNIT, F.col("item").alias("place"), F.col("other").alias("item"))
    same = own.select(F.lit(-1).alias("draw"), *UNIT, F.col("item").alias("place"), "item")
    return reduce(DataFrame.unionByName, [moved, same])


def null_statistics(grams: DataFrame, plan: DataFrame, permuted: DataFrame, size: int) -> DataFrame:
    """draw, partition, state_a, state_b, statistic: the plan's sum over places of the products that a draw puts together, by size (items times features)."""
    at = lambda k: permuted.select("draw", "place", F.col("donor").alias(f"donor_{k}"), F.col("state").alias(f"state_{k}"), F.col("item").alias(f"item_{k}"))
    pairs = plan.select("donor_l", "state_l", "donor_r", "state_r").distinct()
    shown = pairs.join(at("l"), ["donor_l", "state_l"]).join(at("r"), ["donor_r", "state_r", "draw", "place"])
    term = shown.join(grams, ["donor_l", "state_l", "item_l", "donor_r", "state_r", "item_r"]).groupBy("draw", "donor_l", "state_l", "donor_r", "state_r").agg(F.sum("dot").alias("dot"))
    both = term.join(plan, ["donor_l", "state_l", "donor_r", "state_r"])
    return both.groupBy("draw", "partition", "state_a", "state_b").agg((F.sum(F.col("coefficient") * F.col("dot")) / size).alias("statistic"))


def sides(units: DataFrame) -> DataFrame:
    """kind, part, side, donor: the halves of donors (kind 'halves'), and each donor against all others (kind 'rest', part its place)."""
    from .ranks import numbered

    axis = numbered(units.select("donor").distinct(), F.col("donor").asc()).withColumn("part", (F.col("place") - 1).cast("int")).drop("place")
    one = axis.select(F.lit("rest").alias("kind"), "part", F.lit(0).alias("side"), "donor")
    others = axis.alias("a").join(axis.alias("b"), F.col("a.donor") != F.col("b.donor")).select(F.lit("rest").alias("kind"), F.col("a.part").alias("part"), F.lit(1).alias("side"), F.col("b.donor").alias("donor"))
    return halves(units).select(F.lit("halves").alias("kind"), F.col("partition").alias("part"), "side", "donor").unionByName(one).unionByName(others)


def truth_ceiling(df: DataFrame, dealt: DataFrame, block: dict[str, str]) -> DataFrame:
    """kind, part, block, cosine: agreement of both sides' interactions of state and item, over all features (block 'all') and by block.

    df(donor, state, item, feature, value); dealt: see sides(); block: feature -> its block. A side is the mean over its donors;
    state and item means are taken out of it feature by feature. States, items and donors are axes of the design.
    """
    mean = df.join(dealt, "donor").groupBy("kind", "part", "side", "state", "item", "feature").agg(F.avg("value").alias("v"))
    own = ["kind", "part", "side", "feature"]
    m = lambda name, *keys: mean.groupBy(*own, *keys).agg(F.avg("v").alias(name))
    g = mean.join(m("__s", "state"), [*own, "state"]).join(m("__i", "item"), [*own, "item"]).join(m("__a"), own)
    g = g.withColumn("g", F.col("v") - F.col("__s") - F.col("__i") + F.col("__a"))
    named = F.create_map(*(F.lit(x) for kv in block.items() for x in kv))
    g = g.select("kind", "part", "side", "state", "item", "feature", "g", F.explode(F.array(F.lit("all"), F.element_at(named, F.col("feature")))).alias("block"))
    side = lambda k: g.filter(F.col("side") == k).select("kind", "part", "block", "state", "item", "feature", F.col("g").alias(f"g{k}"))
    both = side(0).join(side(1), ["kind", "part", "block", "state", "item", "feature"])
    from ..functions.expr import safe_ratio

    a, b = F.col("g0"), F.col("g1")
    return both.groupBy("kind", "part", "block").agg(safe_ratio(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))


def matching_summaries(df: DataFrame, feature: str, unit: list[str]) -> DataFrame:
    """feature -> variance (the mean over contexts of the sum of both replicates' products) and reliability (their correlation over all units). df(replicate, unit, feature, value), unit with a context."""
    from .shrinkage import correlation

    side = lambda k: df.filter(F.col("replicate") == k).select(*unit, feature, F.col("value").alias(f"v{k}"))
    both = side(0).join(side(1), [*unit, feature])
    return both.groupBy(feature).agg((F.sum(F.col("v0") * F.col("v1")) / F.count_distinct("context")).alias("variance"), correlation("v0", "v1").alias("reliability"))
