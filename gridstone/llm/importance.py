"""Target-distribution importance resampling over position-table n-grams.

A text's words become rows with their positions (posexplode). Window lead() within a
document puts the following words beside each, which gives the n-grams of every order;
each is hashed into one of BUCKETS. The documents' buckets are written once, a row a
position; they are counted over all documents and over the target, the log ratios become
a table of BUCKETS gains, which joins the positions, and gains are summed by document.
Scores with Gumbel noise of the document's own hash are then ranked: what comes first is a
sample without replacement in proportion to the weights.

Texts are dealt out once, long ones in stretches of STRETCH words that carry the words after them, so that a very long text is many groups and a window
holds no more than a stretch. Ranks
come from range partitions and the numbers of rows before them, never from one sorted
task. The gains are at most BUCKETS rows, which bounds what is broadcast.

Defined cases: a null or wordless text has no features, weight 0 and no rank; the id of
a null doc_id is the empty text; rows with equal ids score alike where their texts are
equal and have ranks of their own, in the order in which they were read; an empty table
of documents gives an empty result, an empty target leaves t and T at 0; other columns
play no part in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, plain_words, written

#: Buckets, longest run of words, words of a document that may be drawn, percentage that is drawn.
BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words of a stretch; a text of at most twice as many characters can't hold more words.
STRETCH = 4000


def positions(docs: DataFrame, key: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, key, b1, b2, ...: the bucket of the run of 1, 2, ... words that begins at each position (null past the end); a row of nulls for a text without words."""
    text = F.coalesce("text", F.lit(""))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(STRETCH)), lambda k: F.array_join(F.slice(w, k + 1, F.lit(STRETCH + orders - 1)), " "))
    df = docs.select(F.col(key), "text").withColumn("row", F.monotonically_increasing_id())
    df = df.select("row", key, F.posexplode(F.when(F.length(text) > 2 * STRETCH, let(plain_words(text), cut)).otherwise(F.array(text))).alias("at", "words"))
    df = df.repartition("row", "at")  # exploding keeps this partitioning, so that the window needs no further exchange
    df = df.select("row", "at", key, F.posexplode_outer(plain_words(F.col("words"))).alias("pos", "w1"))
    order = Window.partitionBy("row", "at").orderBy("pos")
    df = df.withColumns({f"w{k + 1}": F.lead("w1", k).over(order) for k in range(1, orders)})
    df = df.filter(F.col("pos").isNull() | (F.col("pos") < STRETCH))
    spaced = lambda k: [x for j in range(1, k + 1) for x in (F.lit(" "), F.col(f"w{j}"))][1:]
    runs = [F.concat(*spaced(k)) if k > 1 else F.col("w1") for k in range(1, orders + 1)]  # null past the end
    return df.select("row", key, *((F.crc32(x.cast("binary")) % buckets).cast("smallint").alias(f"b{k}") for k, x in enumerate(runs, 1)))


def counts(table: DataFrame, name: str, orders: int = ORDERS) -> DataFrame:
    """bucket -> number of features."""
    return table.select(F.explode(F.array(*(f"b{k}" for k in range(1, orders + 1)))).alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the target's smoothed share of a bucket over the source's, for the source's buckets. source(bucket, s), target(bucket, t)."""
    total = source.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s")).join(target.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t")))  # one row each
    df = source.join(target, "bucket", "left").join(F.broadcast(total))
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    return df.select("bucket", F.floor(1000 * F.log((t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets)))).cast("bigint").alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) of the key's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank 1, 2, ... in an order that leaves no ties, and total, the number of rows: ranks inside range partitions, plus the rows of those before."""
    held = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranks")
    parts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.orderBy("__part")  # a row a partition
    parts = parts.withColumn("__before", F.sum("__n").over(every) - F.col("__n")).withColumn("total", F.sum("__n").over(Window.partitionBy()))
    df = held.join(F.broadcast(parts.drop("__n")), "__part")
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")).cast("bigint")).drop("__part", "__before")


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, key, n_words, n_features, weight, score of every row of docs."""
    table = written(positions(docs, key, orders, buckets), "ngram-positions")
    own = positions(target.select(F.lit(0).alias("__key"), "text"), "__key", orders, buckets)
    gain = gains(counts(table, "s", orders), counts(own, "t", orders), buckets)
    names, df = [f"b{k}" for k in range(1, orders + 1)], table
    for n in names:  # the gains of a position's features side by side, then summed by document
        df = df.join(F.broadcast(gain.withColumnsRenamed({"bucket": n, "gain": f"gain_{n}"})), n, "left")
    total = lambda each: sum(map(each, names[1:]), each(names[0]))
    weight = F.sum(total(lambda n: F.coalesce(f"gain_{n}", F.lit(0))))
    df = df.groupBy("row", key).agg(F.count("b1").alias("n_words"), total(F.count).alias("n_features"), weight.cast("bigint").alias("weight"))
    return df.withColumn("score", F.col("weight") + noise(F.col(key), seed))


def drawn(scores: DataFrame, key: str, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """row, rank of the rows with the highest scores: that percentage of the rows of least_words words or more, ties to the smaller key."""
    few = scores.filter(F.col("n_words") >= least_words).select("row", key, "score")
    df = numbered(few, F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("row").asc())
    return df.filter(F.col("rank") <= F.floor(percent * F.col("total") / 100)).select("row", "rank")


def importance_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    df = written(scored(docs.select("doc_id", "text"), benchmark), "importance-scores")
    return df.join(drawn(df, "doc_id"), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with the columns of docs."""
    held = written(docs.withColumn("__id", F.monotonically_increasing_id()), "importance-documents")
    df = scored(held.select("__id", "text"), target, "__id", seed).select(F.col("row"), F.col("__id"), "n_words", "weight")
    keys = held.select("__id", F.col(key).alias("__key"))
    df = written(df.join(keys, "__id").withColumn("score", F.col("weight") + noise(F.col("__key"), seed)), "importance-scores")
    best = drawn(df, "__key", percent).join(df.select("row", "__id"), "row").select("__id")
    return held.join(best, "__id", "left_semi").select(*docs.columns)


# CRC-32 by its table of 256 entries, computed from the polynomial; each distinct feature once
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT side, row, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b, unnest(w[3:] || [NULL, NULL]) AS c FROM w),
f AS (SELECT side, row, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS t FROM p),
n AS (SELECT side, row, t, count(*) AS k FROM f WHERE t IS NOT NULL GROUP BY ALL),
e AS (SELECT t, hex(encode(t)) AS x FROM (SELECT DISTINCT t FROM n)),
y AS (SELECT t, list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)) AS bytes FROM e),
z AS (SELECT t, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
u AS (SELECT side, row, bucket, k FROM n JOIN z USING (t)),
s AS (SELECT bucket, sum(k) FILTER (side = 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 1), 0)::DOUBLE AS t FROM u GROUP BY 1),
a AS (SELECT coalesce(sum(k) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 1), 0)::DOUBLE AS t FROM u),
g AS (SELECT bucket, floor(1000 * ln((s.t + 1) * (a.s + 10000) / ((s.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM s, a WHERE s.s IS NOT NULL),
v AS (SELECT row, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM u JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
o AS (SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM w LEFT JOIN v USING (row) WHERE side = 0),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, count(*) OVER () AS total FROM q WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * total // 100 THEN rank END AS rank FROM q LEFT JOIN r USING (row)
"""
