"""Evidence bodies and bounded packets: ordered prefixes that stop at the first violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import contracts
from siftwell.operators.discovery import line_window


def json_string(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def window_of(source: contracts.Source, detail: str) -> contracts.Window:
    return source.expanded if detail == "expanded" else source.standard


def bodies(found: DataFrame, detail: str = "standard") -> DataFrame:
    """Candidates with ``evidence``; ``found`` has the detail's line window as ``_window``."""
    place = F.concat_ws(":", "source", F.col("line").cast("string"), F.col("column").cast("string"))
    body = F.concat_ws("\n", F.lit("provider=generic-source"), F.lit(f"detail={detail}"), F.concat(F.lit("pattern="), "pattern_label"), F.concat(F.lit("location="), place), F.concat(F.lit("matched="), json_string(F.col("match_text"))), "_window")
    return found.withColumn("evidence", body).drop("_window")


def with_windows(found: DataFrame, files: DataFrame, window: contracts.Window) -> DataFrame:
    """``found``, a few candidates, with the ``_window`` of their files (source, text), read again."""
    lines = files.join(F.broadcast(found.select("source").distinct()), "source", "left_semi").select("source", F.split(F.coalesce("text", F.lit("")), "\r?\n", -1).alias("_lines"))
    return found.join(lines, "source").withColumn("_window", line_window(F.col("_lines"), F.col("line"), window)).drop("_lines")


def packed(items: DataFrame, budget: contracts.Budget, key: str | None = None, order: str = "ord", clip_first: bool = False, size: Column | None = None, most: int | None = None) -> DataFrame:
    """The prefix of each packet (``key``) within items, sources and characters. Each running figure takes in the item that breaks
    a bound and never falls, so the filter is the prefix. ``clip_first`` cuts a first item that is too long instead of refusing it."""
    if not key:  # one packet: only the rows that can be in it are brought together
        items = items.orderBy(order).limit(budget.max_items)
    part = [key] if key else [F.lit(0)]
    items = items.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(order))).where(F.col("_n") <= budget.max_items)
    run = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first_of_source = F.row_number().over(Window.partitionBy(*part, "source").orderBy(order)) == 1
    rows = items.withColumn("_new", first_of_source.cast("int"))
    if clip_first:
        rows = rows.withColumn("evidence", F.when(F.col("_n") == 1, F.substring("evidence", 1, budget.max_chars)).otherwise(F.col("evidence")))
    rows = rows.withColumn("_s", F.sum("_new").over(run)).withColumn("_c", F.sum(F.length("evidence")).over(run))
    keep = (F.col("_s") <= budget.max_sources) & (F.col("_c") <= budget.max_chars)
    if size is not None:
        rows = rows.withColumn("_t", F.sum(size).over(run))
        keep = keep & (F.col("_t") <= most)
    return rows.where(keep).drop("_new", "_n", "_s", "_c", "_t")


def token_bounded(items: DataFrame, budget: contracts.Budget, key: str | None = None, order: str = "ord", envelope: int = 64) -> DataFrame:
    """The prefix whose serialized items, with an envelope, take at most ``max_tokens`` at four characters a token."""
    one = F.length(F.to_json(F.struct("id", "source", "evidence"))) + 1
    return packed(items, budget, key, order, size=one, most=budget.max_tokens * 4 - envelope)


def packet_stats(packed_items: DataFrame, key: str) -> DataFrame:
    return packed_items.groupBy(key).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source").alias("source_count"), F.sum(F.length("evidence")).cast("long").alias("chars"))


def trim_reason(requested: Column, by_provider: Column, by_tokens: Column) -> Column:
    """Which bound cut a packet: items asked for, left by the provider, left by the token budget."""
    provider, tokens = by_provider < requested, by_tokens < by_provider
    return F.when(provider & tokens, "both").when(provider, "adapter_bounds").when(tokens, "token_budget").otherwise("none")
