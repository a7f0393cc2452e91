"""Review: decisions folded into per-target states, packets, progress, stability and the checks of coverage.

The first decision on a target is its standard attempt; a second one counts only after INSUFFICIENT_EVIDENCE, as the expanded
attempt; later ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.contracts import NEUTRAL, Disposition
from siftwell.operators import tables
from siftwell.operators.classify import ratio

MORE = "INSUFFICIENT_EVIDENCE"


def contract_table(spark, dispositions: tuple[Disposition, ...] = NEUTRAL) -> DataFrame:
    return spark.createDataFrame([(d.id, d.terminal, d.finding) for d in dispositions], "disposition string, terminal boolean, finding boolean")


def attempts(decisions: DataFrame, order: list[str]) -> DataFrame:
    """(target, detail, disposition) of the decisions that count, from (target, disposition, ...order)."""
    w = Window.partitionBy("target").orderBy(*order)
    numbered = decisions.withColumn("k", F.row_number().over(w)).withColumn("before", F.lag("disposition").over(w))
    used = numbered.where((F.col("k") == 1) | ((F.col("k") == 2) & (F.col("before") == MORE)))
    return used.select("target", F.when(F.col("k") == 1, "standard").otherwise("expanded").alias("detail"), "disposition")


def states(targets: DataFrame, used: DataFrame) -> DataFrame:
    """(target, state, final_disposition): pending, needs_expanded, reviewed or blocked."""
    per = used.groupBy("target").agg(F.max(F.when(F.col("detail") == "standard", F.col("disposition"))).alias("first"), F.max(F.when(F.col("detail") == "expanded", F.col("disposition"))).alias("second"))
    last = F.coalesce("second", "first")
    state = F.when(F.col("first").isNull(), "pending").when(last != MORE, "reviewed").when(F.col("second").isNull(), "needs_expanded").otherwise("blocked")
    final = F.when(last != MORE, last).when(F.col("second").isNotNull(), MORE)
    return targets.select("target").distinct().join(per, "target", "left").select("target", state.alias("state"), final.alias("final_disposition"))


def progress(state: DataFrame, used: DataFrame) -> DataFrame:
    """One row of counts and rates."""
    s, f = F.col("state"), F.col("final_disposition")
    a = state.agg(F.count(F.lit(1)).alias("targets"), F.count_if(s == "reviewed").alias("reviewed"), F.count_if(s == "blocked").alias("blocked"), F.count_if(s == "needs_expanded").alias("needs_expanded"), F.count_if(s != "reviewed").alias("unreviewed"), F.count_if(s.isin("pending", "needs_expanded")).alias("reviewable_remaining"), F.count_if((s == "reviewed") & (f == "CONFIRM")).alias("findings"))
    expanded = F.col("detail") == "expanded"
    b = used.agg(F.count_if(~expanded).alias("evidence_seen"), F.count_if(expanded).alias("expanded_attempted"), F.count_if(expanded & (F.col("disposition") != MORE)).alias("expanded_resolved"))
    both = a.join(F.broadcast(b))  # one row each
    return both.select("*", ratio(F.col("expanded_attempted"), F.col("targets")).alias("expansion_rate"), ratio(F.col("expanded_resolved"), F.col("expanded_attempted")).alias("expanded_resolution_rate"), (F.col("reviewable_remaining") > 0).alias("resume_available"))


def disposition_counts(contract: DataFrame, rows: DataFrame, column: str = "disposition") -> DataFrame:
    """Events or finals by disposition, zero where there are none."""
    n = rows.groupBy(F.col(column).alias("disposition")).agg(F.count(F.lit(1)).alias("n"))
    return contract.select("disposition").join(n, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def packets(state: DataFrame, target_items: int) -> DataFrame:
    """(target, detail, packet): needs-expanded targets first, then pending ones, ``target_items`` to a packet."""
    open_ = state.where(F.col("state").isin("pending", "needs_expanded")).withColumn("detail", F.when(F.col("state") == "needs_expanded", "expanded").otherwise("standard"))
    placed = tables.ranked(open_.select("target", "detail"), ["detail", "target"], "rank", "packets")
    first = placed.groupBy("detail").agg(F.min("rank").alias("first"))  # two rows
    return placed.join(F.broadcast(first), "detail").select("target", "detail", F.floor((F.col("rank") - F.col("first")) / target_items).cast("long").alias("packet"))


def coverage_issues(packet: DataFrame, decisions: DataFrame, contract: DataFrame) -> DataFrame:
    """(id, issue): missing, extra, repeated, unknown_disposition, blank_rationale. Empty means that the decisions apply."""
    d = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    cover = packet.select("id").withColumn("in_packet", F.lit(True)).join(d, "id", "full")
    issue: Column = F.when(F.col("n").isNull(), "missing").when(F.col("in_packet").isNull(), "extra").when(F.col("n") > 1, "repeated")
    a = cover.select("id", issue.alias("issue")).where("issue IS NOT NULL")
    b = decisions.join(F.broadcast(contract), "disposition", "left_anti").select("id", F.lit("unknown_disposition").alias("issue"))
    c = decisions.where(F.coalesce(F.trim("rationale"), F.lit("")) == "").select("id", F.lit("blank_rationale").alias("issue"))
    return a.unionByName(b).unionByName(c)


def stability(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row comparing two manifests of (id, disposition)."""
    j = previous.select("id", F.col("disposition").alias("p")).join(current.select("id", F.col("disposition").alias("c")), "id", "full")
    p, c = F.col("p"), F.col("c")
    both = p.isNotNull() & c.isNotNull()
    was, now = F.coalesce(p == "CONFIRM", F.lit(False)), F.coalesce(c == "CONFIRM", F.lit(False))
    stuck, sticks = F.coalesce(p == MORE, F.lit(False)), F.coalesce(c == MORE, F.lit(False))
    n = j.agg(
        F.count(p).alias("previous_total"), F.count(c).alias("current_total"), F.count_if(both).alias("common"), F.count_if(both & (p == c)).alias("stable"), F.count_if(both & (p != c)).alias("changed"),
        F.count_if(~was & now).alias("new_confirm"), F.count_if(was & ~now).alias("lost_confirm"), F.count_if(was & now).alias("stable_confirm"),
        F.count_if(~stuck & sticks).alias("new_blocked"), F.count_if(stuck & ~sticks).alias("resolved_blocked"), F.count_if(stuck & sticks).alias("stable_blocked"),
    )
    return n.select("*", ratio(F.col("stable"), F.col("common")).alias("stability_rate"))
