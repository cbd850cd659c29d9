"""What grows with the tables: bytes shuffled, runs of what is ranked, and windows over outer units."""

import re
import time

from pyspark.sql import functions as F


def shuffled(spark, run):
    """What run() gives, and the bytes that it shuffled."""

    def total():
        sc = spark.sparkContext._jsc.sc()
        time.sleep(0.3)
        spark.range(1).count()  # brings the executors' figures up to date
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(True)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = total()
    return run(), total() - before


def test_row_group_scan_deals_no_rows(spark):
    from gridstone.plans import registry

    rows, moved = shuffled(spark, lambda: registry.queries()["row_group_scan"](spark, "/root/testdata/sf0.01").collect())
    assert [tuple(r) for r in rows] == [(r.flag, r.rows, r.quantity) for r in spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").filter("l_returnflag = 'R'").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")).collect()]
    assert moved < 10_000


def test_shrunk_covariance_deals_rows_once(spark):
    from gridstone.operators import shrinkage

    df = spark.range(30_000).select((F.col("id") % 2).cast("string").alias("group"), F.concat(F.lit("row-"), F.col("id").cast("string")).alias("row"), *(F.rand(k).alias(f"n{k}") for k in range(4)))
    df.unpivot(["group", "row"], [f"n{k}" for k in range(4)], "name", "value").write.mode("overwrite").saveAsTable("long_rows")
    df = spark.table("long_rows")
    once = shuffled(spark, lambda: df.groupBy("group", "row").agg(F.collect_list(F.struct("name", "value")).alias("xs")).agg(F.max(F.size("xs"))).collect())[1]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, moved = shuffled(spark, lambda: shrinkage.shrunk(df).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sql("DROP TABLE long_rows")
    assert len(out) == 32 and moved < 1.5 * once


def test_shrunk_covariance_of_repeated_and_missing_values(spark):
    """As its SQL says: values of a row and name meet all others of the row, one by one."""
    from gridstone.operators import shrinkage

    rows = [("g", "r1", "a", 1.0), ("g", "r1", "a", 3.0), ("g", "r1", "b", 2.0), ("g", "r2", "a", -1.0), ("g", "r3", "b", 5.0), ("g", "r3", "c", 4.0)]
    mean = {n: sum(v for *_, m, v in rows if m == n) / sum(m == n for *_, m, _ in rows) for n in "abc"}
    want = {}
    for _, r, a, x in rows:
        for _, s, b, y in rows:
            if r == s:
                want[a, b] = want.get((a, b), 0.0) + (x - mean[a]) * (y - mean[b]) / 3
    got = {(r.a, r.b): r["cov"] for r in shrinkage.covariance(spark.createDataFrame(rows, "`group` string, row string, name string, value double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_nested_draws_hold_no_outer_unit_in_a_task(spark):
    from gridstone.operators import inference

    df = spark.range(2000).select((F.col("id") % 2).cast("string").alias("o"), F.col("id").alias("i"))
    out = inference.nested_draws(df, "o", "i", 3, "s")
    assert not re.search(r"windowspecdefinition\(o#\d+, ", out._jdf.queryExecution().toString())  # partitioned by o
    assert {r["n"] for r in out.groupBy("draw").agg(F.sum("times").alias("n")).collect()} == {2000}


def test_ranks_run_once_what_they_rank(spark):
    from gridstone.operators import ranks

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("id % 7 AS x", "id % 5 AS y", "id AS z").mapInArrow(count, "x bigint, y bigint, z bigint")
    got = ranks.average_ranks(df, "x", "y", "z").collect()
    assert len(got) == 100 and sum(r.r_z for r in got) == sum(r.r_x for r in got) == 5050 and seen.value == 100
