"""Structured Streaming forms of the chunked accumulators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by tumbling window and key; works on a stream, with a watermark, and on a table."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(time, late)
    return df.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end into a memory table (tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
