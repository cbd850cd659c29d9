"""Benchmark decontamination by a prefix-filtered join of shingles (native).

An item's windows are WINDOW consecutive words, or all of an item that has fewer. To be
found, a window must occur as it stands, so that all its shingles (WIDTH words, or the
whole of a shorter window) must occur in a row. That is used in four steps.

1. Bits. A bitmap of the shingles' hashes, BITS_PER a shingle and MOST_BITS at most, goes
   to every task. A document keeps only its runs of words all of whose shingles are in the
   map and which are long enough for a window: nothing of most texts, and no occurrence
   is lost. As a window of n words has n - WIDTH + 1 shingles in a row, one of every so
   many places is probed, and its neighbours only where it is in the map. Where the
   benchmark is so large that the map fills up, runs are merely longer. Runs are cut into
   pieces; an occurrence belongs to the piece in which it begins.
2. Rarity. The pieces' shingles are counted. Of a window with a shingle that never occurs
   nothing can be found; of any other, the rarest shingle is its prefix, which suffices
   where a window must be contained whole.
3. Join. The pieces' shingles meet prefixes by hash: the shingle's place gives the
   window's place, which must begin and end inside the piece.
4. Verification. The words at that place must equal the window's.

Texts are read once and never shuffled; pieces are written to the shared folder, from
which all later steps start, so that a lost executor costs a task. Prefixes and items of
windows are broadcast where there are at most SMALL (some 200 bytes each), else the joins
are shuffles in which adaptive execution splits hot keys. Equal windows of several items
are one.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item
has no windows; items with equal ids are one item; a null item_id hits words but is no
item that can be named; repeated rows each get a row, and a null doc_id is a document of
its own; an empty table of either kind gives no hits; columns other than doc_id and text
play no part in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed, let, plain_words, written

#: Words of a window and of a shingle.
WINDOW, WIDTH = 10, 5
BITS_PER, MOST_BITS = 16, 1 << 23
#: Words in which the windows of a piece begin; rows that are broadcast.
PIECE, SMALL = 256, 200_000
PIECES = "array<struct<width: int, start: int, words: array<string>>>"


def shingle(w: Column, at: Column, width: int) -> Column:
    """Hash of width words from a place of an array."""
    return F.xxhash64(*(F.get(w, at + k) for k in range(width)))


def places(w: Column, width: int) -> Column:
    """The places at which shingles of an array begin."""
    return F.sequence(F.lit(0), F.size(w) - width)


def by_width(width: Column, make) -> Column:
    """make(width) of the row's own width."""
    return F.coalesce(*(F.when(width == k, make(k)) for k in range(1, WIDTH + 1)))


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, words, width) of the distinct windows, and (window, item_id) of the items that hold them. A window is named by its SHA-256."""
    df = fixed(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), w=plain_words(F.col("text")))
    df = df.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = df.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.slice("w", i + 1, F.col("n")))).alias("words"))
    each = written(each.select(F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("window"), "words", "item_id").distinct(), "leak-windows")
    return each.select("window", "words", F.least(F.size("words"), F.lit(WIDTH)).alias("width")).distinct(), each.filter("item_id is not null").select("window", "item_id")


def _bit(h: Column) -> Column:
    """A long with the bit that the lowest six of a hash name."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))


def bitmap(hashes: DataFrame) -> tuple[DataFrame, int]:
    """One row with the bitmap of hashes(h) as array<bigint> of 64 bits each, and the number of its bits, a power of two."""
    count, bits = hashes.count(), 1 << 12
    while bits < min(MOST_BITS, BITS_PER * count):
        bits *= 2
    cells = hashes.groupBy(F.shiftrightunsigned(F.col("h").bitwiseAND(bits - 1), 6).alias("id")).agg(F.bit_or(_bit(F.col("h"))).alias("v"))
    every = hashes.sparkSession.range(bits // 64).join(cells, "id", "left")
    packed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))))
    return every.agg(F.transform(packed, lambda s: s["v"]).alias("bits")), bits


def pieces(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """row, doc_id, n_words, pieces: a row a document, with what of its words may hold a window."""
    kinds = distinct.groupBy("width").agg(F.min(F.size("words")).alias("least"))
    found = sorted((r.width, r.least) for r in kinds.collect())  # WIDTH rows at most
    df = fixed(docs.select("doc_id", "text"), w=plain_words(F.col("text")))
    none = F.expr(f"cast(array() as {PIECES})")
    held = none
    if found:
        hashes = distinct.select(F.explode(by_width(F.col("width"), lambda k: F.transform(places(F.col("words"), k), lambda i: shingle(F.col("words"), i, k)))).alias("h")).distinct()
        bits, size = bitmap(hashes)

        def of(w: Column, bits: Column, width: int, least: int) -> Column:
            last, stride = F.size(w) - width, least - width + 1
            marked = lambda i: let(shingle(w, i, width), lambda h: F.get(bits, F.shiftrightunsigned(h.bitwiseAND(size - 1), 6).cast("int")).bitwiseAND(_bit(h)) != 0)
            beside = lambda i: F.sequence(F.greatest(i - (stride - 1), F.lit(0)), F.least(i + (stride - 1), last))
            begins = lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
            ends = lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
            run = lambda a, b: F.struct(a.alias("a"), (b - a + width).alias("n"))
            long = lambda p: F.filter(F.zip_with(begins(p), ends(p), run), lambda r: r["n"] >= least)
            piece = lambda r, k: F.struct(F.lit(width).alias("width"), (r["a"] + k).alias("start"), F.slice(w, r["a"] + k + 1, F.least(r["n"] - k, F.lit(PIECE + WINDOW - 1))).alias("words"))
            cut = lambda r: F.transform(F.sequence(F.lit(0), r["n"] - least, F.lit(PIECE)), lambda k: piece(r, k))
            some = lambda p, then: F.when(F.size(p) == 0, none).otherwise(then)
            every = lambda p: F.filter(F.sort_array(F.array_distinct(F.flatten(F.transform(p, beside)))), marked)
            probed = F.filter(F.sequence(F.lit(0), last, F.lit(stride)), marked)
            # an array of one value, so that each step is computed once
            runs = let(probed, lambda p: some(p, let(every(p), lambda q: F.flatten(F.transform(long(q), cut)))))
            return F.when(F.size(w) < least, none).otherwise(runs)

        df = df.join(F.broadcast(bits))  # one row of MOST_BITS / 8 bytes at most
        held = let(F.struct("w", "bits"), lambda s: F.concat(*(of(s["w"], s["bits"], *k) for k in found)))
    df = fixed(df, n_words=F.size("w").cast("bigint"), pieces=held)
    return written(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "pieces"), "leak-pieces")


def _sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast where it has at most SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def hits(held: DataFrame, distinct: DataFrame) -> DataFrame:
    """row, start, size, window: every place at which a window occurs, from pieces() and windows()."""
    piece = held.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    hashed = by_width(F.col("width"), lambda k: F.transform(places(F.col("words"), k), lambda i: shingle(F.col("words"), i, k)))
    count = piece.select("width", F.explode(hashed).alias("h")).groupBy("width", "h").agg(F.count(F.lit(1)).alias("n"))
    own = distinct.select("window", "words", "width", F.posexplode(hashed).alias("offset", "h"))
    n = F.coalesce("n", F.lit(0))
    rare = own.join(count, ["width", "h"], "left").groupBy("window").agg(F.min_by(F.struct("words", "width", "offset", "h"), F.struct(n, "h", "offset")).alias("p"), F.min(n).alias("n"))
    prefix = written(rare.filter("n > 0").select("window", "p.width", "p.offset", "p.h", F.col("p.words").alias("wanted")), "leak-prefixes")

    first = lambda i: F.greatest(i - (WINDOW - 1), F.lit(0))
    near = lambda i: F.slice("words", first(i) + 1, F.lit(2 * WINDOW - 1))
    seen = by_width(F.col("width"), lambda k: F.transform(places(F.col("words"), k), lambda i: F.struct(i.alias("place"), shingle(F.col("words"), i, k).alias("h"), near(i).alias("near"))))
    at = piece.select("row", "width", "start", F.size("words").alias("n"), F.inline(seen))
    begin = F.col("place") - F.col("offset")
    inside = (begin >= 0) & (begin < PIECE) & (begin + F.size("wanted") <= F.col("n"))
    same = F.slice("near", F.greatest(begin - first(F.col("place")), F.lit(0)) + 1, F.size("wanted")) == F.col("wanted")
    both = at.join(_sized(prefix), ["width", "h"]).filter(inside & same)
    return both.select("row", (F.col("start") + begin).alias("start"), F.size("wanted").alias("size"), "window")


def covered(spans: Column) -> Column:
    """How many places spans array<struct<start, size>> cover."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    new = lambda acc, s: F.greatest(s["start"] + s["size"] - F.greatest(s["start"], acc["upto"]), F.lit(0))
    step = lambda acc, s: F.struct((acc["n"] + new(acc, s)).cast("bigint").alias("n"), F.greatest(acc["upto"], s["start"] + s["size"]).alias("upto"))
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id, n_words, spans array<struct<start, size>> (null: none) and items array<string>, sorted (null: none), a row a document."""
    distinct, items = windows(benchmark)
    held = pieces(docs, distinct)
    found = written(hits(held, distinct), "leak-hits")
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"))  # no more than 10 a word of the document
    named = found.select("row", "window").distinct().join(_sized(items), "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return held.select("row", "doc_id", "n_words").join(spans, "row", "left").join(named, "row", "left")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    df = contaminated(docs, benchmark)
    n, none = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("bigint"), F.expr("cast(array() as array<string>)")
    df = df.withColumn("n_hit", n).withColumn("i", F.coalesce("items", none))
    return df.select("doc_id", "n_words", "n_hit", F.size("i").cast("bigint").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, most: float = 0.0) -> DataFrame:
    """The documents of whose words a share of at most `most` is hit, with their columns: rows of one doc_id and text fare alike."""
    held = written(docs.withColumn("__id", F.monotonically_increasing_id()), "leak-documents")
    df = contaminated(held.select(F.col("__id").alias("doc_id"), "text"), benchmark)
    bad = df.filter(covered(F.col("spans")) > most * F.col("n_words")).select(F.col("doc_id").alias("__id"))
    return held.join(bad, "__id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS t FROM b, range(0, 1000000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(len(w), 10)),
z AS (SELECT DISTINCT size FROM v),
p AS (SELECT row, size, unnest(range(0, len(w) - size + 1)) AS i, w FROM d, z WHERE len(w) >= size),
g AS (SELECT row, size, i, array_to_string(w[i + 1:i + size], ' ') AS t FROM p),
h AS (SELECT DISTINCT g.row, g.i, g.size, v.item_id FROM g JOIN v ON g.t = v.t AND g.size = v.size),
n AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM h, range(10) r(k) WHERE k < size GROUP BY row),
m AS (SELECT row, list_sort(list(DISTINCT item_id) FILTER (item_id IS NOT NULL)) AS items FROM h GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN m USING (row)
"""
