"""Mixing sources to target weights by the cube method.

Sizes are words. A source's target is its weighted share of ``share`` times all words, stopped at ``cap`` times the source; what
stops flows to the others by weight (the targets are min(cap * size, level * weight); running sums over the sources in the order in
which they stop give the level). Of a source each document is taken floor(target / size) times whole, and once more with the inclusion probability that is left.

The cube method draws these: probabilities move along directions that keep the expected words and documents of a block, until all
but two or fewer are 0 or 1. Blocks are stretches of ``BLOCK`` rows of a source in the order of a hash of the text, the id and the
size; those left of all blocks form the next blocks, and the last few of a source land by their own probabilities. So a source's
taken words are within a few documents of its target, whatever its size, and no task holds more than a block, even if all rows are
alike. Draws depend on the documents' texts, ids, sizes and the seed alone, so reruns agree.

A null text has size 0; documents of size 0 are drawn like others and take no words. A null source is a source, the last in
order. Repeated rows and ids are drawn each on its own. An empty table gives an empty table. Other columns pass through
:func:`mixed` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WEIGHTS, SHARE, CAP, BLOCK, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 4096, 20240601
NOBODY = -(1 << 63)  # stands for a null id


def words(text: str = "text") -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source_key, source_size, n_docs, weight, target) from (source_key, source_size, n_docs): one row per source. The weights go
    round in the order of the keys, which is that of the sources' code points, null last."""
    ranked = shared.materialize(shared.ranked(sources, ["source_key"], "rank", "sources"), "targets")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked.withColumn("weight", weight)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = _level(table.select("source_key", (cap * F.col("source_size")).alias("stop"), "weight"), share * total)
    return table.select("source_key", "source_size", "n_docs", "weight", F.least(cap * F.col("source_size"), F.lit(level) * F.col("weight")).alias("target"))


def _level(table: DataFrame, wanted: float) -> float:
    """The level at which the sum of min(stop, level * weight) is ``wanted``, infinite if all stops together are less."""
    weights = table.agg(F.sum("weight")).first()[0] or 0.0
    sums = shared.running_total(table.withColumn("at", F.col("stop") / F.col("weight")), ["at", "source_key"], "stop", "stops", "mix-stops")
    sums = shared.running_total(sums, ["at", "source_key"], "weight", "passed", "mix-weights")
    # where a source stops, those before it have stopped and the rest are at its level
    left, before = weights - F.col("passed") + F.col("weight"), F.col("stops") - F.col("stop")
    first = sums.where(before + F.col("at") * left >= wanted).agg(F.min(F.struct("at", "source_key", before.alias("before"), left.alias("left"))).alias("x")).select("x.*").first()
    return float("inf") if first["at"] is None else (wanted - first["before"]) / first["left"]


def flight(pi: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two lie between 0 and 1, keeping their sum and their sum times size."""
    p, x = pi.tolist(), sizes.tolist()
    draws = iter(rng.random(len(p) + 8).tolist())
    hand: list[int] = []
    tiny = 1e-12
    for k in range(len(p)):
        if tiny < p[k] < 1 - tiny:
            hand.append(k)
        if len(hand) < 3:
            continue
        a, b, c = hand
        # orthogonal to (1, 1, 1) and to the sizes
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(hand, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(hand, u):
            p[i] += step * d
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        hand = [i for i in hand if 0 < p[i] < 1]
    return np.array(p)


def _block_draw(last: bool):
    def draw(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["order", "doc_id", "size"], kind="stable", na_position="first")
        name = f"{SEED}|{key[0]}|{key[1]}|{len(block)}|{int(block['order'].iloc[0])}"
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(name.encode("utf-8", "surrogatepass")).digest()[:8], "little")))
        p = flight(block["pi"].to_numpy(float), block["size"].to_numpy(float), rng)
        open_ = (p > 0) & (p < 1)
        if last and open_.any():  # landing: the few that are left, one by one
            p[open_] = (rng.random(int(open_.sum())) < p[open_]).astype(float)
        return block.assign(pi=p)

    return draw


def sampled(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``drawn`` (0.0 or 1.0) for every row of (row, doc_id, size, source_key, pi, order, ...) by the cube method within source_key;
    ``row`` tells alike rows apart."""
    spark, done = docs.sparkSession, None
    schema = docs.schema
    now = docs
    while True:
        placed = shared.materialize(shared.ranked(now, ["source_key", "order", "doc_id", "size", "row"], "rank", "mix-ranked"), "mix-placed")
        counts = shared.materialize(placed.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")), "mix-counts")
        most = counts.agg(F.max("n")).first()[0]
        if most is None:
            break
        last = most <= block
        cut = shared.lookup_join(placed, counts, ["source_key"], "inner").select(*schema.names, F.expr(f"(rank - first) div {block}").alias("cell"))
        out = shared.materialize(cut.groupBy("source_key", "cell").applyInPandas(_block_draw(last), cut.schema).drop("cell"), "mix-level")
        shared.release(placed, counts)
        settled = out.where("pi <= 0 OR pi >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        now = out.where("pi > 0 AND pi < 1")
    return (done if done is not None else spark.createDataFrame([], schema)).withColumnRenamed("pi", "drawn")


def _key(source: Column) -> Column:
    """A source as a key that is never null: '+' and the source, or for null a key behind all those."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, order, size, source, source_size, target, times, taken) per row; order is a hash of the text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("order"), words(text_col).alias("size"), _key(F.col(source_col).cast("string")).alias("source_key"))
    rows = shared.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    # a source's rows are summed before they shuffle
    sums = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    table = shared.materialize(targets(sums, weights, share, cap).select("source_key", "source_size", "target"), "mix-targets")
    full = shared.lookup_join(rows, table, ["source_key"], "inner")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = full.withColumn("whole", F.floor(ratio)).withColumn("pi", ratio - F.floor(ratio)).select("row", "doc_id", "order", "size", "source_key", "source_size", "target", "whole", "pi")
    drawn = sampled(parts)
    times = F.col("whole") + F.col("drawn").cast("long")
    source = F.when(F.col("source_key") == "-", F.lit(None)).otherwise(F.expr("substring(source_key, 2)"))
    return drawn.select(F.when(F.col("doc_id") != F.lit(NOBODY), F.col("doc_id")).alias("doc_id"), "order", "size", source.alias("source"), "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, each as often as it is taken, all columns kept. Rows alike in id, text and source share what they were
    drawn together as evenly as can be; of those that get one more, a hash of all columns decides."""
    times = plan(docs, weights, share, cap, id_col, text_col, source_col)
    k1, k2, k3, n, whole, tie, rank, least = (shared.fresh(docs, x) for x in ("mix_id", "mix_order", "mix_rows", "mix_times", "mix_hash", "mix_tie", "mix_rank", "mix_first"))
    nobody = F.lit(NOBODY)
    key = times.groupBy(F.coalesce("doc_id", nobody).alias(k1), F.xxhash64("order", _key(F.col("source"))).alias(k2)).agg(F.sum("times").alias(n), F.count(F.lit(1)).alias(k3))
    key = shared.materialize(key, "mix-times")
    text = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    marked = docs.withColumn(k1, F.coalesce(docs[id_col].cast("long"), nobody)).withColumn(k2, F.xxhash64(text, _key(docs[source_col].cast("string"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = marked.join(key.where((F.col(n) > 0) & (F.col(k3) == 1)), [k1, k2]).select(*columns, F.col(n).cast("int").alias(n))
    alike = shared.materialize(key.where((F.col(n) > 0) & (F.col(k3) > 1)), "mix-alike")
    if alike.take(1):
        twins = shared.lookup_join(marked, alike, [k1, k2], "inner").withColumn(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")])).withColumn(tie, F.monotonically_increasing_id())
        placed = shared.materialize(shared.ranked(twins, [k1, k2, whole, tie], rank, "mix-twins"), "mix-twins-placed")
        firsts = placed.groupBy(k1, k2).agg(F.min(rank).alias(least))
        more = F.when(F.col(rank) - F.col(least) < F.expr(f"`{n}` % `{k3}`"), 1).otherwise(0)
        joined = joined.unionByName(placed.join(firsts, [k1, k2]).select(*columns, (F.expr(f"`{n}` div `{k3}`") + more).cast("int").alias(n)))
    return joined.withColumn(n, F.explode(F.expr(f"array_repeat(1, `{n}`)"))).select(*columns)
