"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more component, sqrt(M - |v|^2) with M the largest squared norm, and
queries get 0 there, so that a query's highest inner products are its nearest neighbours. A vector's key is
its nearest pivot and its distance to it. Sorted by key, vectors are packed into
blocks: annuli of one pivot's cell. For a query at distance d of the pivot, all of an
annulus [lo, hi] lies at least max(lo - d, d - hi) away, by the triangle inequality.
A query expands its annuli in order of this bound until they hold k candidates, whose
k-th score is a radius; then all others whose bound doesn't exceed the radius, and it
stops. Queries and vectors meet in blocks of bounded size, whatever the data hold.

The pivots come from at most SAMPLE vectors, chosen by hash; every vector is indexed.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no
part; shorter vectors are as if padded with zeros; ties go to the smaller id; fewer
candidates than k give fewer rows; repeated ids are candidates of their own, but for
rows of the query's id, which are none of its candidates; equal rows (id and vector)
ask once, different vectors of one id each ask for themselves; a null id takes no part;
an empty table gives an empty result; other columns play no part. Scores are whole
numbers, exact at any size of the components; what 64 bits can't hold, a component or
a score, counts as the largest or smallest of them.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed, written

PIVOTS, SAMPLE = 64, 2048
BLOCK, QUERY_BLOCK = 1024, 128
DIRECTORY = 200_000
#: Of the largest norm: beyond what rounding does to a distance, whose square has a relative error near 1e-16.
SLACK = 1e-6


def scaled(x: Column) -> Column:
    """floor(256 * x) of each component; null for a vector that takes no part."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    whole = F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("bigint"))
    return F.when((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(good(v), F.lit(False))), whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of int64, shorter ones padded with zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots(width + 1 components), extra being the rows' last component."""
    x = x.astype(float)
    sq = (x**2).sum(1) + extra**2
    d = sq[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(d, 0))


def _farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of int64 rows: as doubles or 64-bit numbers while these are exact, else as Python's."""
    norms = [np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)) for x in (a, b)]
    most = norms[0] * norms[1] * 1.001
    if most < 2**52 and max(norms) < 2**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """A vector in 4 bytes a component, or 8 where one needs them."""
    kind = np.int32 if len(x) == 0 or np.abs(x.astype(float)).max() < 2**31 - 1 else np.int64
    return np.ascontiguousarray(x.astype(kind)).tobytes()


def _unpack(xs, n: int, width: int) -> np.ndarray:
    """n vectors, packed one by one, as int64."""
    raw = memoryview(xs)
    if len(raw) == 4 * n * width:
        return np.frombuffer(raw, np.int32).reshape(n, width).astype(np.int64)
    return np.frombuffer(raw, np.int64).reshape(n, width)


def _joined(parts: list[bytes], width: int) -> bytes:
    """Packed vectors of a block, all of one kind."""
    if len({len(x) for x in parts}) > 1:
        parts = [x if len(x) == 8 * width else np.frombuffer(x, np.int32).astype(np.int64).tobytes() for x in parts]
    return b"".join(parts)


def build(vectors: DataFrame) -> dict:
    """vectors(id, v: scaled components) -> the index: pivots, and blocks of sorted keys as a written table."""
    spark = vectors.sparkSession
    vectors = written(vectors.filter(F.col("v").isNotNull()), "topk-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    width, most, n = vectors.agg(F.max(F.size("v")), F.max(norm), F.count(F.lit(1))).first()
    if not n:
        return {"vectors": vectors, "n": 0}
    # a hash threshold leaves about 1.5 * SAMPLE vectors of any table to be ordered, so that no task sends more than its share
    h = F.xxhash64("v", "id")
    near = F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.5 * SAMPLE / n))
    few = vectors.filter(near).orderBy(h).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    few = _matrix(few, width).astype(float) if len(few) else np.zeros((1, width))
    few = np.concatenate([few, np.sqrt(np.maximum(most - (few**2).sum(1), 0))[:, None]], 1)
    pivots = spark.sparkContext.broadcast(_farthest_first(few, PIVOTS))

    def keyed(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            d = _distances(x, pivots.value, np.sqrt(np.maximum(most - (x.astype(float) ** 2).sum(1), 0)))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array([_pack(r) for r in x], pa.binary())], ["id", "cell", "dist", "x"])

    def blocked(size):
        def run(batches):
            held: list[pa.RecordBatch] = []

            def out(part: pa.Table):
                cell, dist = part.column("cell").to_numpy(), part.column("dist").to_numpy()
                cuts = np.flatnonzero(np.diff(cell)) + 1
                rows = []
                for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
                    for b in range(lo, hi, size):
                        e = min(b + size, hi)
                        ids = np.ascontiguousarray(part.column("id").slice(b, e - b).to_numpy()).tobytes()
                        rows.append((int(cell[b]), float(dist[b]), float(dist[e - 1]), e - b, ids, _joined(part.column("x").slice(b, e - b).to_pylist(), width)))
                return pa.RecordBatch.from_pylist([dict(zip(("cell", "lo", "hi", "n", "ids", "xs"), r)) for r in rows], schema=pa.schema([("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("xs", pa.binary())]))

            total = 0
            for batch in batches:
                held.append(batch)
                total += batch.num_rows
                if total >= 8 * size:
                    yield out(pa.Table.from_batches(held))
                    held, total = [], 0
            if held:
                yield out(pa.Table.from_batches(held))

        return run

    kind = "cell int, lo double, hi double, n int, ids binary, xs binary"
    keys = vectors.select("id", "v").mapInArrow(keyed, "id bigint, cell int, dist double, x binary")
    parts = max(1, min(2000, n // (4 * BLOCK)))
    blocks = keys.repartitionByRange(parts, "cell", "dist", "id").sortWithinPartitions("cell", "dist", "id").mapInArrow(blocked(BLOCK), kind)
    # each row's number is its own: a hash of what it holds
    blocks = written(fixed(blocks, block=F.xxhash64("cell", "lo", "hi", "ids")), "topk-index")
    return {"vectors": vectors, "n": n, "width": width, "most": most, "pivots": pivots, "blocks": blocks, "keyed": keyed, "blocked": blocked, "kind": kind}


def search(index: dict, queries: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, seen: the k best of all other rows for every indexed row that queries selects; seen: with how many rows it was compared."""
    spark = index["vectors"].sparkSession
    if not index["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint, seen bigint")
    width, most, pivots = index["width"], index["most"], index["pivots"]
    blocks = index["blocks"]
    chosen = index["vectors"].filter(queries).select("id", "v").distinct().mapInArrow(index["keyed"], "id bigint, cell int, dist double, x binary")
    asked = chosen.repartitionByRange("cell", "dist", "id").sortWithinPartitions("cell", "dist", "id").mapInArrow(index["blocked"](QUERY_BLOCK), index["kind"])
    asked = written(fixed(asked.select("ids", "xs"), qb=F.xxhash64("ids", "xs")), "topk-queries")

    def unpack(ids, xs):
        ids = np.frombuffer(ids, np.int64)
        return ids, _unpack(xs, len(ids), width)

    def bounds(x, directory):
        """Distance to each pivot, and the least distance to each block, of each row."""
        d = _distances(x, pivots.value, np.zeros(len(x)))[:, directory["cell"]]  # a query's last component is 0
        return np.maximum(np.maximum(directory["lo"] - d, d - directory["hi"]), 0)

    def slices():
        """The directory in parts of at most DIRECTORY blocks: pieces by hash, none larger than planned but by chance."""
        parts = -(-blocks.count() // DIRECTORY)
        for p in range(parts):
            t = blocks.filter(F.pmod("block", F.lit(parts)) == p).select("block", "cell", "lo", "hi", "n").toArrow()
            yield spark.sparkContext.broadcast({c: t.column(c).to_numpy() for c in t.column_names})

    def meet(plan: DataFrame) -> DataFrame:
        """plan(qb, block, use: the positions of queries to compare) -> qb, pos, query_id, vec_id, score, seen: each query's k best of each block, the first with the block's size."""

        def run(batches):
            for batch in batches:
                out = [[] for _ in range(6)]
                for qb, qi, qx, ids, xs, use in zip(*(batch.column(c) for c in ("qb", "qids", "qxs", "ids", "xs", "use"))):
                    qid, q = unpack(qi.as_buffer(), qx.as_buffer())
                    vid, v = unpack(ids.as_buffer(), xs.as_buffer())
                    at = np.frombuffer(use.as_buffer(), np.int16)
                    scores = _scores(q[at], v)
                    for pos, own, s in zip(at, qid[at], scores):
                        ok = np.flatnonzero(vid != own)
                        if len(ok) > k:
                            least = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                            ok = ok[s[ok] >= least]
                        ok = ok[np.lexsort((vid[ok], -s[ok]))[:k]]
                        seen = np.zeros(len(ok), np.int64)
                        seen[:1] = len(vid)
                        for held, x in zip(out, (np.full(len(ok), qb.as_py()), np.full(len(ok), pos), np.full(len(ok), own), vid[ok], s[ok], seen)):
                            held.append(x.astype(np.int64))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["qb", "pos", "query_id", "vec_id", "score", "seen"])

        left = plan.join(asked.withColumnsRenamed({"ids": "qids", "xs": "qxs"}), "qb").join(blocks.select("block", "ids", "xs"), "block")
        return left.select("qb", "qids", "qxs", "ids", "xs", "use").mapInArrow(run, "qb bigint, pos bigint, query_id bigint, vec_id bigint, score bigint, seen bigint")

    def planned(directory, radius=None):
        """First expansion without a radius; else all that the radius of each query reaches and the first left out."""

        def first(b, n):
            order = np.argsort(b, axis=1, kind="stable")
            need = np.cumsum(n[order], axis=1) - n[order] <= k  # with the query's own row, k + 1 are wanted
            take = np.zeros(b.shape, bool)
            np.put_along_axis(take, order, need, 1)
            return take

        later = radius is not None

        def run(batches):
            d = directory.value
            for batch in batches:
                for row in range(batch.num_rows):
                    qid, q = unpack(batch.column("ids")[row].as_buffer(), batch.column("xs")[row].as_buffer())
                    b = bounds(q, d)
                    take = first(b, d["n"])
                    if later:
                        r = np.asarray(batch.column("radius")[row].values)
                        take = (b <= r[:, None] + SLACK * (1 + most) ** 0.5) & ~take
                    hit = np.flatnonzero(take.any(0))
                    use = [np.flatnonzero(take[:, j]).astype(np.int16).tobytes() for j in hit]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("qb")[row].as_py()] * len(hit), pa.int64()), pa.array(d["block"][hit]), pa.array(use, pa.binary())], ["qb", "block", "use"])

        source = asked if radius is None else radius
        return written(source.mapInArrow(run, "qb bigint, block bigint, use binary"), "topk-plan")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("qb", "pos").orderBy(F.col("score").desc(), F.col("vec_id"))  # k rows a block
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = None
    for directory in slices():
        if found is None:
            found = written(best(meet(planned(directory))).drop("rank"), "topk-found")
            most_of = found.groupBy("qb", "pos").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            each = asked.select("qb", "ids", "xs")

            def explode(batches):
                for batch in batches:
                    for row in range(batch.num_rows):
                        qid, q = unpack(batch.column("ids")[row].as_buffer(), batch.column("xs")[row].as_buffer())
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column("qb")[row].as_py()] * len(qid), pa.int64()), pa.array(np.arange(len(qid), dtype=np.int32)), pa.array(qid), pa.array((q.astype(float) ** 2).sum(1))], ["qb", "pos", "query_id", "sq"])

            names = each.mapInArrow(explode, "qb bigint, pos int, query_id bigint, sq double")
            reach = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.col("sq") + most - 2.0 * F.col("kth").cast("double"), F.lit(0.0))))
            radius = names.join(most_of, ["qb", "pos"], "left").groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("pos", reach.alias("r")))).alias("rs"))  # QUERY_BLOCK rows
            radius = written(each.join(radius.select("qb", F.col("rs.r").alias("radius")), "qb"), "topk-radius")
            found = found.unionByName(meet(planned(directory, radius)))
        else:
            found = found.unionByName(meet(planned(directory, radius))).unionByName(meet(planned(directory)))
    seen = found.groupBy("qb", "pos").agg(F.sum("seen").alias("total"))
    found = best(found.drop("seen")).join(seen, ["qb", "pos"])
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.col("total").alias("seen"))


def topk_report(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best of all other rows for each row whose vec_id is divisible by every."""
    vectors = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), scaled(F.col("embedding")).alias("v")).filter("id is not null")
    return search(build(vectors), F.col("id") % every == 0, k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS query_id, q.x, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

