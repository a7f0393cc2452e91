"""Tables in the shared folder, and total orders without one task holding all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.contracts import ContractError


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and all runs in one process, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ContractError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/siftwell/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written as Parquet and read back, which cuts their lineage and outlives executors."""
    path = new_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranked(rows: DataFrame, order: list, rank: str, tag: str) -> DataFrame:
    """``rows`` with their 0-based rank in a total order of columns: a range shuffle sorts, the place in the partition and a table of
    one row a partition add up."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), tag)
    counts = placed.groupBy(F.shiftright("_mid", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))  # a row a partition
    joined = placed.withColumn("_part", F.shiftright("_mid", 33)).join(F.broadcast(offsets), "_part")
    return joined.withColumn(rank, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_part", "_off")
