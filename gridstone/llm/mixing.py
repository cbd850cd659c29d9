"""Mixing sources to target weights by hash-threshold histograms (native).

Each document has a 36-bit hash of its id. Tokens are summed by source and leading
hash bits; the running sum over buckets gives the bucket in which a source's budget
ends; only that bucket is split by its next bits, twice more. What results is one
threshold a source: a filter, never a sort of documents.

Defined cases: a null or wordless text has size 0 and takes nothing; a null source is
a source of its own, ranked last; repeated rows (equal ids) share one hash and are
taken together; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

BITS, LEVELS = 12, 3
#: The weights of the sources in order, repeating; the share of all sizes that is mixed; the most of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def hash36(doc_id: Column) -> Column:
    """The first 36 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes(source, source_size), a row a source -> with target: share of all by weight, none above most times its size.

    With caps at most * size, the level t of target = min(cap, t * weight) is the
    largest of the levels met when sources are capped in order of cap / weight.
    The windows run over one row a source, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    df = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    df = df.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    df = df.withColumn("level", F.max("level").over(every))
    return df.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with __size, __source_size, __target and __copies (how often the mix takes the document)."""
    narrow = written(docs.select(F.col("source"), hash36(F.col("doc_id")).alias("h"), word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    #: spent: tokens in the buckets before the threshold; cut: the threshold's leading bits
    state = written(plan.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("spent", F.lit(0).cast("bigint")).withColumn("cut", F.lit(0).cast("bigint")), "mix-plan")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        at = state.select(F.col("source").alias("s"), "cut", "spent", "rest")
        inside = narrow.join(at, narrow.source.eqNullSafe(at.s)).filter(F.shiftright("h", shift + BITS) == F.col("cut"))
        bucket = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.max("spent").alias("spent0"), F.max("rest").alias("rest"))
        run = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))  # at most 2**BITS rows a source
        bucket = bucket.withColumn("upto", F.col("spent0") + run).withColumn("before", F.col("upto") - F.col("n"))
        edge = bucket.filter(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct("bucket", "before", "n"), "bucket").alias("e"))
        edge = edge.select(F.col("s"), F.col("e.bucket").alias("to"), F.col("e.before").alias("before"), F.col("e.n").alias("n"))
        joined = state.join(edge, state.source.eqNullSafe(edge.s), "left")
        take = F.lit(0)
        if level == LEVELS - 1:  # the last bucket goes in where that comes nearer to the budget
            take = F.when(F.col("rest") - F.col("before") >= F.col("n") / 2, 1).otherwise(0)
        past = F.lit(1).cast("bigint") * (1 << (BITS * (level + 1)))  # no edge: everything inside fits
        cut = F.when(F.col("to").isNotNull(), F.col("to") + take).when(F.col("rest") <= 0, 0).otherwise(past)
        state = written(joined.select("source", "source_size", "target", "full", "rest", F.coalesce("before", "spent").alias("spent"), cut.cast("bigint").alias("cut")), "mix-plan")
    at = state.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("full").alias("__full"), F.col("cut").alias("__cut"))
    df = docs.withColumn("__h", hash36(F.col("doc_id"))).withColumn("__size", word_count(F.col("text")))
    df = df.join(at, F.col("source").eqNullSafe(F.col("__s")))
    return df.withColumn("__copies", (F.col("__full") + (F.col("__h") < F.col("__cut")).cast("int")).cast("int")).drop("__s", "__full", "__cut", "__h")


def mix_report(docs: DataFrame) -> DataFrame:
    """Size, source size, target and taken words of each document."""
    df = mixed(docs.select("doc_id", "source", "text"))
    return df.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a row for each time that one is taken, with the columns of docs."""
    columns = docs.columns
    df = mixed(docs).filter(F.col("__copies") > 0)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
b AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM b)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (r.whole + CASE WHEN c.upto <= r.rest OR (c.upto - c.n <= r.rest AND c.upto > r.rest AND r.rest - (c.upto - c.n) >= c.n / 2.0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
