"""The review fold on a stream of decisions: each micro-batch is added to a log, states follow from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import review


def follow(decisions: DataFrame, log: str, checkpoint: str):
    """Start a query that writes each micro-batch of (target, disposition, ts, seq) under its number, so a batch that is run again
    replaces itself; ends when what is there is read."""

    def add(batch: DataFrame, number: int) -> None:
        batch.select("target", "disposition", "ts", "seq").write.mode("overwrite").parquet(f"{log}/batch={number}")

    return decisions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold(spark: SparkSession, log: str) -> DataFrame:
    """States by the log so far."""
    seen = spark.read.parquet(log).select("target", "disposition", "ts", "seq")
    return review.states(seen.select("target"), review.attempts(seen, ["ts", "seq"]))


def windowed_dispositions(decisions: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Decisions by day and disposition under a watermark, for monitoring a running review."""
    return decisions.withWatermark("ts", delay).groupBy(F.window("ts", width), "disposition").agg(F.count(F.lit(1)).alias("n"))
