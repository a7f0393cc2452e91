"""Screening: guard, size filter, scoring, five buckets, accounting, manifest, refinement and the score cache.

Outcomes are one long table: ord, id, bucket (kept, dropped, undecided, withheld, errors), probability, reason. Buckets come from column
expressions over one scored column, so a screen is a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.contracts import ContractError, Stage, Thresholds

#: A scorer gives STRUCT<stop_reason string, answer_type string, probability double> from (id, text).
Scorer = Callable[[Column, Column], Column]
BUCKETS = ("kept", "dropped", "undecided", "withheld", "errors")
CALL_LIMIT = 200


def answer(probability: Column, stop: Column | str = "stop", kind: Column | str = "bool") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(stop).alias("stop_reason"), lit(kind).alias("answer_type"), probability.cast("double").alias("probability"))


def hash_probability(contract: str, id_: Column, text: Column) -> Column:
    """A pure, well spread stand-in for a classifier: the first 32 bits of an MD5 as a fraction."""
    digest = F.md5(F.concat_ws("|", F.lit(contract), id_.cast("string"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_scorer(contract: str) -> Scorer:
    return lambda id_, text: answer(hash_probability(contract, id_, text))


def lookup_scorer(table: dict[str, float | str]) -> Scorer:
    """Scores by id, for tests: a probability, or error, malformed, throw, aborted."""
    entries = [F.lit(x) for pair in ((k, str(v)) for k, v in table.items()) for x in pair]

    def score(id_: Column, text: Column) -> Column:
        value = F.create_map(*entries)[id_.cast("string")]
        number = value.try_cast("double")
        return F.when(value == "throw", answer(F.lit(None), "exception")).when(value == "error", answer(F.lit(None), "error")).when(value == "aborted", answer(F.lit(None), "aborted")).when(value == "malformed", answer(F.lit(2.0))).otherwise(answer(number))

    return score


def bucket_of(probability: Column, limits: Thresholds) -> Column:
    """Both thresholds are inclusive."""
    return F.when(probability >= F.lit(limits.keep), "kept").when(probability <= F.lit(limits.drop), "dropped").otherwise("undecided")


def preflight(count: int, limit: int = CALL_LIMIT) -> str:
    if count < 0 or limit < 1:
        raise ContractError("count and limit are positive")
    return "approval_required" if count > limit else "ok"


def preflight_status(count: Column, limit: int = CALL_LIMIT) -> Column:
    """:func:`preflight` for a column of counts."""
    if limit < 1:
        raise ContractError("count and limit are positive")
    return F.when(count > limit, "approval_required").otherwise("ok")


def validate(items: DataFrame) -> int:
    """Fail closed on null, blank or repeated ids and null texts; the number of items."""
    n, ids, bad = items.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_if(F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == "") | F.col("text").isNull())).first()
    if bad or ids != n:
        raise ContractError("items have null, blank or repeated ids, or null texts")
    return n


def tokens_of(text: Column, overhead: int = 0) -> Column:
    return F.ceil((F.length(text) + overhead) / 4)


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with a column that is computed once a row: being generated, it isn't copied into what uses it."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def screen(items: DataFrame, scorer: Scorer, limits: Thresholds, *, confirm: bool = True, count: int | None = None, call_limit: int = CALL_LIMIT, context_window: int | None = None, fraction: float = 0.85, overhead: int = 0) -> DataFrame:
    """(ord, id, bucket, probability, reason) for (ord, id, text). ``count`` is the number of items, for the guard."""
    if not confirm and preflight(items.count() if count is None else count, call_limit) != "ok":
        return items.select("ord", "id", F.lit("withheld").alias("bucket"), F.lit(None).cast("double").alias("probability"), F.lit("approval_required").alias("reason"))
    large = too_large(F.col("text"), context_window, fraction, overhead)
    scored = once(items.select("ord", "id", "text", large.alias("large")), F.when(~F.col("large"), scorer(F.col("id"), F.col("text"))), "a")
    return bucketed(scored, limits).drop("message")


def too_large(text: Column, context_window: int | None, fraction: float = 0.85, overhead: int = 0) -> Column:
    """Whether an item takes more than its share of the model's window; nothing is too large for a window that isn't known."""
    return tokens_of(text, overhead) > max(1, int(context_window * fraction)) if context_window else F.lit(False)


def bucketed(scored: DataFrame, limits: Thresholds) -> DataFrame:
    """(ord, id, bucket, probability, reason, message) of (ord, id, large, a) and, where it is there, message."""
    p, stop = F.col("a.probability"), F.col("a.stop_reason")
    valid = (F.col("a.answer_type") == "bool") & p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
    reason = (
        F.when(F.col("large"), "too_large")
        .when(F.col("a").isNull() | (stop == "exception"), "classifier_exception")
        .when(stop == "aborted", "aborted")
        .when(stop == "error", "classifier_error")
        .when(~F.coalesce(valid, F.lit(False)), "malformed_answer")
    )
    message = F.col("message") if "message" in scored.columns else F.lit(None).cast("string")
    rows = scored.select("ord", "id", reason.alias("reason"), p.alias("p"), message.alias("message"))
    bucket = F.when(F.col("reason") == "too_large", "withheld").when(F.col("reason").isNotNull(), "errors").otherwise(bucket_of(F.col("p"), limits))
    return rows.select("ord", "id", bucket.alias("bucket"), F.when(F.col("reason").isNull(), F.col("p")).alias("probability"), "reason", "message")


def contract_of(stage: Stage) -> str:
    """What a score depends on besides its item, as one string."""
    return "|".join([stage.question, stage.yes, stage.no, repr(stage.thresholds)])


def summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def efficiency(outcomes: DataFrame, hits: Column | None = None) -> DataFrame:
    """One row; a review is avoided for each dropped item."""
    n = outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bucket") == "dropped").alias("dropped"), F.count_if(F.col("bucket") != "dropped").alias("retained"), (F.count_if(hits) if hits is not None else F.lit(0).cast("long")).alias("cache_hits"))
    return n.select("total", "dropped", "retained", (F.col("total") - F.col("retained")).alias("review_avoided"), "cache_hits", ratio(F.col("dropped"), F.col("total")).alias("reduction_rate"), ratio(F.col("total") - F.col("retained"), F.col("total")).alias("review_avoidance_rate"), ratio(F.col("cache_hits"), F.col("total")).alias("cache_hit_rate"))


def retained(outcomes: DataFrame) -> DataFrame:
    """All but the dropped, in the order kept, undecided, withheld, errors; ``rank`` sorts them."""
    place = F.create_map(*[F.lit(x) for pair in (("kept", 0), ("undecided", 1), ("withheld", 2), ("errors", 3)) for x in pair])
    return outcomes.where("bucket <> 'dropped'").withColumn("bucket_rank", place[F.col("bucket")])


def manifest(outcomes: DataFrame, limits: Thresholds, labels: tuple[str, ...] = (), candidates: DataFrame | None = None) -> DataFrame:
    """Labels, confidence and reasons of a run, with locations where the candidates have them."""
    label = F.create_map(*[F.lit(x) for pair in (("kept", "KEEP"), ("dropped", "DROP"), ("undecided", "UNDECIDED"), ("withheld", "WITHHELD"), ("errors", "ERROR")) for x in pair])[F.col("bucket")]
    p, k, d = F.format_string("%.6f", F.col("probability")), f"{limits.keep:.6f}", f"{limits.drop:.6f}"
    why = (
        F.when(F.col("bucket") == "kept", F.concat(F.lit("keepProbability "), p, F.lit(f" >= keep threshold {k}")))
        .when(F.col("bucket") == "dropped", F.concat(F.lit("keepProbability "), p, F.lit(f" <= drop threshold {d}")))
        .when(F.col("bucket") == "undecided", F.concat(F.lit("keepProbability "), p, F.lit(f" is between drop threshold {d} and keep threshold {k}")))
        .otherwise(F.concat_ws(": ", "reason", F.col("message") if "message" in outcomes.columns else F.lit(None).cast("string")))
    )
    sure = F.when(F.col("bucket") == "kept", F.col("probability")).when(F.col("bucket") == "dropped", F.lit(1.0) - F.col("probability"))
    out = outcomes.select("ord", "id", label.alias("label"), sure.alias("confidence"), why.alias("reason"))
    if labels:
        out = out.where(F.col("label").isin(*dict.fromkeys(labels)))
    return out if candidates is None else out.join(candidates.select("id", "source", "line", "column"), "id", "left")


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 200) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 1000:
        raise ContractError("offset or limit out of bounds")
    return rows.orderBy(*order).offset(offset).limit(limit)


def accounting_issues(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ids that break the partition: missing, extra, or in more than one outcome. Empty if all is well."""
    a = items.groupBy("id").agg(F.count(F.lit(1)).alias("n_in"))
    b = outcomes.groupBy("id").agg(F.count(F.lit(1)).alias("n_out"))
    issue = F.when(F.col("n_out").isNull(), "missing").when(F.col("n_in").isNull(), "extra").when(F.col("n_in") != F.col("n_out"), "repeated")
    return a.join(b, "id", "full").select("id", issue.alias("issue")).where("issue IS NOT NULL")


def fingerprints(items: DataFrame, contract: str) -> DataFrame:
    """items with contract_fp and candidate_fp; line ends are made alike first."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    return items.withColumn("contract_fp", F.sha2(F.lit(contract), 256)).withColumn("candidate_fp", F.sha2(F.to_json(F.struct(F.col("id").cast("string").alias("id"), text.alias("text"))), 256))


def cache_split(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Fingerprinted items with the cached bucket and probability, null where missed."""
    return items.join(cache.select("contract_fp", "candidate_fp", F.col("bucket").alias("cached_bucket"), F.col("probability").alias("cached_probability")), ["contract_fp", "candidate_fp"], "left")


def screen_cached(items: DataFrame, contract: str, cache: DataFrame, scorer: Scorer, limits: Thresholds, **options) -> DataFrame:
    """Outcomes with ``hit``: only missed items are scored, and the guard counts only these."""
    return merge_hits(cache_split(fingerprints(items, contract), cache), lambda missed: screen(missed, scorer, limits, **options))


def merge_hits(split: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the cache has, and ``score`` of the rest."""
    hits = split.where("cached_bucket IS NOT NULL").select("ord", "id", F.col("cached_bucket").alias("bucket"), F.col("cached_probability").alias("probability"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("hit"))
    missed = split.where("cached_bucket IS NULL").select("ord", "id", "text")
    return hits.unionByName(score(missed).withColumn("hit", F.lit(False)), allowMissingColumns=True)


def cache_write(cache: DataFrame, fresh: DataFrame, most: int = 50_000) -> DataFrame:
    """The newest ``most`` entries by last_access; only decided buckets are kept. A newer entry replaces its key's older one."""
    both = cache.unionByName(fresh.where(F.col("bucket").isin("kept", "dropped", "undecided")))
    best = both.groupBy("contract_fp", "candidate_fp").agg(F.max(F.struct("last_access", "bucket", "probability")).alias("e")).select("contract_fp", "candidate_fp", "e.*")
    return best.orderBy(F.desc("last_access"), "contract_fp", "candidate_fp").limit(most)


def usage_rollup(calls: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Field-wise sums over calls that report usage, in groups of ``by``; complete if all do; an optional field is null where no call
    has it."""
    reported = F.col(required[0]).isNotNull()
    n, m = F.count(F.lit(1)), F.count_if(reported)
    return calls.groupBy(*by).agg(n.alias("calls"), m.alias("usage_reported_calls"), (n == m).alias("complete"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in required], *[F.sum(c).alias(c) for c in optional])


def first_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
