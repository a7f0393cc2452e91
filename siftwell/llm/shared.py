"""Helpers that the operators of this subpackage share: tables in the shared folder, ranks over a whole table, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that an Arrow batch to a Python worker holds at most; with long texts this bounds the worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: A lookup side of at most so many rows and bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: What this process keeps from task to task, by a key.
_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this process until another key is asked for or :func:`forget` is called. Python workers
    outlive a stage, so that without this the tables of all operators that ever ran would add up."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Give back the memory of what operators before keep in this process."""
    if _KEPT:
        _KEPT.clear()
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where that is unset and all runs in one process (tests) a
    new temporary one. A cluster without it is an error, since its machines don't share a temporary folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/siftwell/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote. Nothing may read the tables any more."""
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if not re.search(r"/siftwell/[\w-]+-[0-9a-f]{32}$", name):
                continue
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since texts may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``big`` with one row per key. ``small`` (materialized) is broadcast when its counted rows and their bytes are few; beyond
    that the join shuffles, where adaptive execution splits the hot keys of ``big`` (``small`` has one row for each)."""
    wide = [f.name for f in small.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    texts = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide), F.lit(0))
    rows, data = small.agg(F.count(F.lit(1)), F.sum(texts)).first()
    few = rows <= BROADCAST_ROWS and (data or 0) + rows * (16 + 8 * len(small.columns)) <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if few else small, keys, how)


def ranked(df: DataFrame, order: list[str], rank: str, tag: str) -> DataFrame:
    """``df`` with its 0-based rank in the total order of ``order`` (nulls first), without one task ever holding all rows: a
    range shuffle sorts, a position in the partition is added, and a table of one row a partition gives the offsets."""
    spark = df.sparkSession
    n, mid = partitions(spark), fresh(df, "mid")
    placed = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id()), tag)
    part, off = fresh(placed, "rank_part"), fresh(placed, "rank_off")
    counts = placed.groupBy(F.shiftright(mid, 33).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(off))  # a row for each shuffle partition
    joined = placed.withColumn(part, F.shiftright(mid, 33)).join(F.broadcast(offsets), part)
    return joined.withColumn(rank, F.col(off) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))).drop(mid, part, off)


def running_total(df: DataFrame, order: list[str], value: str, total: str, tag: str) -> DataFrame:
    """``df`` with the running sum of ``value`` in the total order of ``order``, its own value included."""
    spark = df.sparkSession
    n, part, off = partitions(spark), fresh(df, "sum_part"), fresh(df, "sum_off")
    placed = materialize(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), tag)
    sums = placed.groupBy(part).agg(F.sum(value).alias("n"))
    offsets = sums.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(off))  # a row for each shuffle partition
    inner = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumn(total, F.sum(value).over(inner)).join(F.broadcast(offsets), part)
    return joined.withColumn(total, F.col(total) + F.col(off)).drop(part, off)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, u: str, v: str, rounds: int = 200) -> DataFrame:
    """Connected components of long ids: (id, component) for every id on an edge, the component being its smallest id.

    Alternating large-star and small-star rounds; each is two aggregations and joins that adaptive execution splits on hot
    ids. Each round is a table in the shared folder; a round that changes nothing ends the loop. Nulls and self-loops fall away.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    last = _signature(now)
    for _ in range(rounds):
        if not last[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, now = now, materialize(small, "small")
        release(before, large)
        new = _signature(now)
        if new == last:
            break
        last = new
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    ends = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    found = materialize(now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(ends), "components")
    release(now)
    return found


def utf8(text: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def packed(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with the texts of a column as Zstandard frames, so that they shuffle and lie on disk at two thirds of what the
    shuffle's own compression leaves; :func:`unpacked` gives a text back."""
    bounded_batches(rows.sparkSession)
    at = rows.columns.index(column)
    schema = T.StructType([T.StructField(column, T.BinaryType()) if f.name == column else f for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            made = pa.array([None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def unpacked(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def append(docs: DataFrame, text_col: str, fields: list[tuple[str, str]], compute) -> DataFrame:
    """``docs`` with more columns, made of the texts batch by batch: ``compute(list of texts or None)`` gives a pyarrow array for
    each of ``fields`` (name, SQL type). All other columns go through Arrow as they are."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in fields:
        schema = T.StructType([*schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            made = compute(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[f for f, _ in fields]])

    return docs.mapInArrow(run, schema)
