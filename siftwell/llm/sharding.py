"""Sharding by three laws, in DataFrame operations only.

``bytes``: the minimax contiguous partition. Atomic groups (rows of equal text) stand in the order of their smallest doc_id, and the
running sums of their sizes are the places where a shard may end. A binary search finds the smallest capacity for which cutting
greedily needs no more than the wanted shards. The driver never holds the running sums of all groups: it holds at most
``KNOWN`` of them at a time. With only these a capacity is proved enough (cuts at known places suffice) or too small (even cuts
anywhere between known places don't), and the sums between are read only where a cut can still fall, until both meet. Then the
cuts are laid: each as near to an equal share as the capacity allows, before and behind.

``rows``: counts at most one apart, groups or not. ``key``: rendezvous hashing of doc_id, so shard and count of shards decide,
and one more shard takes rows only into itself.

A null text has no bytes; every row counts 16 bytes more. Equal texts form a group, all null ones another. Rows are ordered by
doc_id, null first, then text; repeated rows stay rows. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SHARDS, OVERHEAD, KNOWN = 40, 16, 1 << 15


class Places:
    """Known running sums, and the stretches between two neighbours of them that hold others."""

    def __init__(self, total: int) -> None:
        self.total, self.known = total, [0, total]
        self.open: set[int] = {total} if total else set()  # a stretch is named by its upper end

    def learn(self, found: list[int], read: list[tuple[int, int, bool]]) -> None:
        """``found`` are sums in the stretches ``read``, which are apart and ascend: (low, high, whole) holds those in (low, high],
        all of them if whole."""
        lows = [low for low, _, _ in read]

        def whole(x: int) -> bool:
            i = bisect_left(lows, x) - 1
            return i >= 0 and x <= read[i][1] and read[i][2]

        self.open = {x for x in {*self.open, *found} if not whole(x)}
        self.known = sorted({*self.known, *found})

    def last(self, limit: int, hopeful: bool) -> int:
        """The farthest end at or below ``limit``: a known one, or hopefully any place in a stretch that holds unknown ones."""
        i = bisect_right(self.known, limit) - 1
        if hopeful and i + 1 < len(self.known) and self.known[i + 1] in self.open:
            return limit
        return self.known[i]

    def needs(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """The ends of greedy shards, None if they are more than ``shards``."""
        at, ends = 0, []
        while at < self.total:
            to = min(self.last(at + capacity, hopeful), self.total)
            if to <= at or len(ends) == shards:
                return None
            ends.append(at := to)
        return ends


def _search(low: int, high: int, enough) -> int:
    """The smallest number in (low, high] that is enough; high is."""
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def minimax_cuts(sums: DataFrame, total: int, largest: int, shards: int, known: int = KNOWN) -> tuple[int, list[int]]:
    """(capacity, ends): ``sums`` has (size, upto), upto being the running sum of sizes. ``ends`` are the cuts, shard by shard."""
    places = Places(total)
    low, high = max(largest, -(-total // shards)) - 1, total
    stretches = [(0, total)]
    for _ in range(64):
        per = max(2, known // max(1, len(stretches)))
        wanted = []
        for a, b in stretches:
            width = max(1, -(-(b - a) // per))
            # the last sum of each cell of a grid over the stretch
            grid = f" AND (upto - {a}) div {width} <> (greatest(upto - size, {a}) - {a}) div {width}" if width > 1 else ""
            wanted.append(f"(upto > {a} AND upto <= {b}{grid})")
        found = sorted({r[0] for r in sums.where(" OR ".join(wanted)).select("upto").collect()})  # at most ``known`` of them
        if set(found) <= set(places.known) and any(b - a > per for a, b in stretches):
            known *= 2  # so coarse a grid finds nothing new, which only a count well below the square of the shards can bring about
        places.learn(found, [(a, b, b - a <= per) for a, b in stretches])
        high = _search(low, high, lambda c: places.needs(c, shards, False) is not None)
        low = _search(low, high, lambda c: places.needs(c, shards, True) is not None) - 1
        if low + 1 >= high:
            break
        # cuts at a capacity in (low, high] fall between those of the surest and of the most hopeful greedy walk
        sure, hope = places.needs(high, shards, False), places.needs(high, shards, True)
        tight = []
        at = 0
        for _k in range(shards):
            at = min(places.last(at + low + 1, False), total)
            tight.append(at)
        stretches = []
        for k in range(max(len(sure), len(hope))):
            a, b = tight[min(k, len(tight) - 1)], hope[min(k, len(hope) - 1)]
            i, j = bisect_right(places.known, a) - 1, bisect_left(places.known, b)
            a, b = places.known[max(0, i)], places.known[min(j, len(places.known) - 1)]
            for x, y in zip(places.known[max(0, i) : j], places.known[max(0, i) + 1 : j + 1]):
                if y in places.open and a <= x and y <= b:
                    stretches.append((x, y))
        stretches = sorted(set(stretches))
        if not stretches:
            break
        merged = [stretches[0]]
        for a, b in stretches[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        while len(merged) > 256:  # few enough for one filter
            gaps = sorted(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1])[: len(merged) // 2]
            for i in sorted(gaps, reverse=True):
                merged[i - 1 : i + 1] = [(merged[i - 1][0], merged[i][1])]
        stretches = merged
    return high, _even(places, high, shards)


def _even(places: Places, capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each the known place nearest to its equal share that leaves enough room before and behind."""
    total, known = places.total, places.known
    least, at = [total], total  # how far the first k shards must reach at least
    for _ in range(shards):
        at = known[min(bisect_left(known, at - capacity), len(known) - 1)] if at > capacity else 0
        least.append(at)
    ends, at = [], 0
    for k in range(1, shards):
        floor, roof = max(at, least[shards - k]), known[bisect_right(known, at + capacity) - 1]
        share = total * k // shards
        i = bisect_right(known, share)
        near = min((x for x in known[max(0, i - 1) : i + 1]), key=lambda x: abs(x - share))
        at = min(max(near, floor), roof)
        ends.append(at)
    return [*ends, total]


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    data = F.coalesce(text, F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("group"))


def _range_of(value: Column, ends: list[int]) -> Column:
    """How many of ``ends`` (but the last) lie at or below ``value``."""
    return F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends[:-1]]), lambda e: e <= value)) if len(ends) > 1 else F.lit(0)


def _slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Gapless slots in each shard, in the order of shard and then of ``order``; no task holds a whole shard."""
    placed = shared.materialize(shared.ranked(rows, ["shard", *order], "rank", "slots"), "ranked")
    base = placed.groupBy("shard").agg(F.min("rank").alias("base"))  # a row per shard
    return placed.join(F.broadcast(base), "shard").withColumn("slot", F.col("rank") - F.col("base"))


def by_bytes(docs: DataFrame, shards: int = SHARDS, known: int = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) by the minimax contiguous partition of groups of equal text."""
    rows = shared.materialize(_sized(docs, id_col, text_col), "sized")
    nobody = F.lit(-(1 << 63))
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.min(F.coalesce("doc_id", nobody)).alias("first"))
    sums = shared.materialize(shared.running_total(groups, ["first", "group"], "size", "upto", "groups"), "sums")
    total, largest = sums.agg(F.max("upto"), F.max("size")).first()
    _, ends = minimax_cuts(sums, total or 0, largest or 0, shards, known)
    # a group lies in the first shard whose end it doesn't pass
    placed = sums.select("group", F.col("upto").alias("place"), _range_of(F.col("upto") - F.col("size"), ends).alias("shard"))
    out = _slots(rows.join(placed, "group"), ["place", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def by_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns, counts at most one apart: contiguous in the order of doc_id."""
    ranked = shared.materialize(shared.ranked(_sized(docs, id_col, text_col), ["doc_id", "group"], "rank", "rows"), "rows-ranked")
    n = ranked.count()
    shard = F.expr(f"cast(rank * {shards} div {max(1, n)} as int)")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def rendezvous(key: Column, shards: int) -> Column:
    """The shard with the highest hash for the key."""
    scores = [F.struct(F.xxhash64(F.coalesce(key, F.lit(-1).cast("long")), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*scores)).getField("s")


def by_key(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns; grown_shard is the shard with one more of them, which is the same or the new one."""
    rows = _sized(docs, id_col, text_col).withColumn("shard", rendezvous(F.col("doc_id"), shards)).withColumn("grown_shard", rendezvous(F.col("doc_id"), shards + 1))
    return _slots(rows, ["doc_id", "group"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
