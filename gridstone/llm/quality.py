"""Quality rules with adaptive thresholds from mergeable quantile sketches (native).

Three densities of a text - symbols and exclamation marks a word, repeated lines a line -
are put into logarithmic buckets, those of 0 into one of their own, and counted by language
and source. The counts are a quantile sketch of fixed relative error: bounded in size,
merged by addition, equal whatever the order of the rows. From it each group has its own
fence, the larger of two: the Tukey rule on the densities of all its texts, which decides
where many texts have the thing, and the upper quartile of those that have it times their
share, which decides where few do. The fences join the documents, and a text above one is
rejected. A text is judged by one occurrence less than it has, so that a single one rejects
no text; where no text has any, the fence is 0 and nothing is rejected. Lengths of texts
play no part but through densities. Only texts of MIN_WORDS words make the sketches, as the
others fail anyway.

The text is read twice, once for the sketches and once for the verdict, so that no
text is ever shuffled. Defined cases: a null text has no words and fails the base
rule; null language or source is a group of its own; a group of fewer than LEAST texts of MIN_WORDS words has the
fences of its language, or of all; without any such text there is nothing to judge;
repeated rows each get a row; an empty table gives an empty result; other columns
stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fixed, let, word_count, written

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[^#*$%&|<>]+"
#: Relative error of the sketch; the reach of the Tukey rule.
ERROR, REACH = 0.01, 3.0
#: A group with fewer texts is judged by the merged sketch of its language, or of all.
LEAST = 30
KINDS = ("symbols", "marks", "dup_lines")
POSITION_BITS = 31  # of any array


def _left(text: Column, dropped: str) -> Column:
    """Code points that remain without the matches."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def densities(less: int = 0) -> dict[str, Column]:
    """Densities of with_lines(), with so many occurrences less, but not below none."""
    per = lambda n, d: F.greatest(n - less, F.lit(0)) / F.greatest(d, F.lit(1))
    return dict(zip(KINDS, (per(F.col("__n_symbols"), F.col("__n_words")), per(F.col("__n_marks"), F.col("__n_words")), per(F.col("__n_dup_lines"), F.col("__n_lines")))))


def bucket(x: Column) -> Column:
    """The logarithmic bucket of a density; null for 0."""
    gamma = (1 + ERROR) / (1 - ERROR)
    return F.when(x > 0, F.ceil(F.log(x) / math.log(gamma)).cast("int"))


def value(b: Column) -> Column:
    """The upper end of a bucket, so that rounding rejects no text."""
    gamma = (1 + ERROR) / (1 - ERROR)
    return F.pow(F.lit(gamma), b)


def with_lines(docs: DataFrame) -> DataFrame:
    """docs with __text (null: empty), __n_words, __n_symbols, __n_marks, __n_lines and __n_dup_lines."""
    df = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    text = F.col("__text")
    lines = let(_lines(text), lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    df = fixed(df, __n_words=word_count(text), __n_symbols=_left(text, SYMBOLS), __n_marks=_left(text, "[^!]+"), __l=lines)
    return df.withColumns({"__n_lines": F.col("__l.n"), "__n_dup_lines": F.col("__l.dup")}).drop("__l")


def sketches(docs: DataFrame) -> DataFrame:
    """Counts by lang, source, density and bucket. Two sketches merge by adding counts."""
    df = with_lines(docs.select("text", "lang", "source")).filter(F.col("__n_words") >= MIN_WORDS)
    df = df.select("lang", "source", F.array(*(bucket(x) for x in densities().values())).alias("bs"))
    # one row a document, counted before the shuffle; then each density's own counts
    df = df.groupBy("lang", "source", "bs").agg(F.count(F.lit(1)).alias("n")).select("lang", "source", "n", F.posexplode("bs").alias("density", "bucket"))
    return df.groupBy("lang", "source", "density", "bucket").agg(F.sum("n").alias("n"))


def levels() -> Column:
    """The sketches that a group's texts are part of: its own, its language's, that of all."""
    none = F.lit(None)
    part = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source"))
    return F.explode(F.array(part(0, F.col("lang"), F.col("source")), part(1, F.col("lang"), none), part(2, none, none)))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source -> the fence of each density, from the first sketch of the group, its language and all that holds LEAST texts (else of all)."""
    whole = sketch.select(levels().alias("k"), "density", "bucket", "n").groupBy("k", "density", "bucket").agg(F.sum("n").alias("n"))  # merged by addition
    group = Window.partitionBy("k", "density")  # rows: buckets, about 1,100 at most
    df = whole.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("all", F.sum("n").over(group))
    df = df.withColumn("none", F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))).over(group), F.lit(0)))
    at = lambda place: F.min(F.struct(F.when(F.col("upto") < place, 1).otherwise(0).alias("past"), F.col("bucket")))["bucket"]  # noqa: E731  of those that reach the place, the first; none sorts first
    level = lambda b: F.coalesce(value(b), F.lit(0.0))
    some = F.col("all") - F.col("none")
    df = df.groupBy("k", "density").agg(F.max("all").alias("texts"), (F.max(some) / F.max("all")).alias("share"), level(at(0.25 * F.col("all"))).alias("q25"), level(at(0.75 * F.col("all"))).alias("q75"), level(at(F.col("none") + 0.75 * some)).alias("upper"))
    df = df.withColumn("fence", F.greatest(F.col("q75") + REACH * (F.col("q75") - F.col("q25")), F.col("share") * F.col("upper")))
    one = lambda k, name: F.max(F.when(F.col("density") == k, F.col("fence"))).alias(f"__fence_{name}")
    names = [f"__fence_{name}" for name in KINDS]
    df = df.groupBy("k").agg(F.max("texts").alias("texts"), *(one(k, name) for k, name in enumerate(KINDS))).filter((F.col("texts") >= LEAST) | (F.col("k.level") == 2))
    own = sketch.select("lang", "source").distinct().select("lang", "source", levels().alias("own"))
    best = own.join(df, F.col("own").eqNullSafe(F.col("k"))).groupBy("lang", "source").agg(F.min_by(F.struct(*names), "k.level").alias("f"))
    return best.select("lang", "source", *(F.col(f"f.{n}") for n in names))


def repeat_words(text: Column) -> Column:
    """Words in 3-word windows that are found twice or more.

    Windows are hashed; hash bits above and window position below make one number a
    window. Sorted, equal windows are neighbours; only those that share the hash bits
    with a neighbour are then compared by their full hash. n log n in the words.
    """
    top = lambda x: F.shiftright(x, POSITION_BITS)
    position = lambda x: x.bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    beside = lambda xs, key: F.filter(xs, lambda x, k: F.coalesce(key(x) == key(F.get(xs, k - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(xs, k + 1)), F.lit(False)))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    packed = lambda h: F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(-(1 << POSITION_BITS)).bitwiseOR(i.cast("bigint"))))
    pairs = lambda h, rough: F.sort_array(F.transform(rough, lambda x: F.struct(F.get(h, position(x)).alias("h"), position(x).alias("i"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-9).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("bigint").alias("n"), i.alias("last"))
    covered = lambda twice: F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, step, lambda acc: acc["n"])
    zero = F.lit(0).cast("bigint")
    exact = lambda h, rough: F.when(F.size(rough) == 0, zero).otherwise(let(pairs(h, rough), lambda p: covered(beside(p, lambda x: x["h"]))))
    within = lambda w: let(hashes(w), lambda h: let(packed(h), lambda p: let(beside(p, top), lambda rough: exact(h, rough))))
    return let(F.filter(F.split(text, SPACE, -1), lambda w: w != ""), lambda w: F.when(F.size(w) < 3, zero).otherwise(within(w)))


def judged(docs: DataFrame) -> DataFrame:
    """docs with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __base_failed, __kept."""
    limits = written(fences(sketches(docs)), "quality-fences")
    df = with_lines(docs)
    text = F.col("__text")
    df = fixed(df, __word_chars=_left(text, SPACE), __n_repeat_words=repeat_words(text))
    df = df.withColumn("__base_failed", (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words")))
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    df = df.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    fits = F.lit(True)
    for name, x in densities(1).items():
        fits = fits & (x <= F.col(f"__fence_{name}"))
    return df.withColumn("__kept", ~F.col("__base_failed") & fits)


def quality_report(docs: DataFrame) -> DataFrame:
    df = judged(docs.select("doc_id", "text", "lang", "source"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return df.select("doc_id", *(F.col(f"__{n}").alias(n) for n in names))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    return judged(docs).filter("__kept").select(*docs.columns)
