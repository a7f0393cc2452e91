"""A screening session: presets, discovery, primary and refinement runs, and the review loop.

Candidates, outcomes, review targets and decisions are tables in the shared folder; the driver holds their names, and one packet of a
bounded number of items at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import contracts
from siftwell.functions.contracts import Budget, ContractError
from siftwell.operators import backends, classify, evidence, redaction, review, tables
from siftwell.sources import providers

DETAILS = ("standard", "expanded")
DECISION = "id string, detail string, disposition string, rationale string, n long"


@dataclass
class Screen:
    """Outcomes of a screen with ``hit``, and what its redaction and its cache did."""

    outcomes: DataFrame
    redaction: dict[str, int]
    evaluated: int
    model: backends.Model | None


@dataclass
class Run:
    preset: contracts.Preset
    scope: str | DataFrame
    candidates: DataFrame
    primary: Screen
    refined: Screen | None = None
    review_id: str | None = None

    @property
    def outcomes(self) -> DataFrame:
        return self.primary.outcomes


@dataclass
class Review:
    """``targets`` (target, ord) is a table; decisions are a table that grows by a packet at a time."""

    preset: contracts.Preset
    scope: str | DataFrame
    targets: DataFrame
    log: str
    pending: dict | None = None
    packets: int = 0
    decided: int = 0
    issues: list[str] = field(default_factory=list)


class Session:
    def __init__(self, spark: SparkSession, scorer_of=classify.hash_scorer, preset_folders: tuple[str, ...] = (), call_limit: int = classify.CALL_LIMIT, backend: backends.Backend | None = None, classifier: str | None = None, fraction: float = 0.85, registry: providers.Registry = providers.REGISTRY, packet_builder: Callable[[list[dict]], list[dict]] | None = None, cache_size: int = 50_000) -> None:
        self.spark, self.folders, self.call_limit, self.fraction, self.registry, self.cache_size = spark, preset_folders, call_limit, fraction, registry, cache_size
        self.backend, self.classifier, self.packet_builder = backend or backends.ColumnBackend(scorer_of), classifier, packet_builder
        self.reset()

    def reset(self) -> None:
        self.runs: dict[str, Run] = {}
        self.reviews: dict[str, Review] = {}
        self.cache = self.spark.createDataFrame([], "contract_fp string, candidate_fp string, bucket string, probability double, last_access long")
        self.clock = 0

    # presets and discovery

    def list_presets(self) -> list[str]:
        return sorted(contracts.load_presets(*self.folders))

    def get_preset(self, name: str) -> contracts.Preset:
        if name.endswith(".json") or "/" in name:
            return contracts.load_preset(name)
        presets = contracts.load_presets(*self.folders)
        if name not in presets:
            raise ContractError(f"no preset {name}")
        return presets[name]

    def discover(self, preset: contracts.Preset, scope: str | DataFrame) -> providers.Result:
        """Candidates with ord, id, text, source, line, or the error that kept them."""
        return providers.guarded(lambda: self.registry.resolve(preset).discover(self.spark, scope))

    def discover_count(self, preset: contracts.Preset, scope: str | DataFrame) -> providers.Result:
        """How many candidates there are, without their texts."""
        try:
            return providers.Result("ok", self.registry.resolve(preset).count(self.spark, scope))
        except (ContractError, OSError, ValueError) as error:
            return providers.Result("error", issues=[str(error)])

    # runs

    def _screen(self, items: DataFrame, stage: contracts.Stage, confirm: bool, rescreen: bool, provider: str | None = None, model: str | None = None) -> Screen:
        """Redact, look up, score what is missed, remember."""
        total = classify.validate(items)
        red = tables.written(redaction.redacted(items.select("ord", "id", "text")), "redacted")
        replaced = red.agg(F.count_if(F.col("redactions") > 0).alias("items"), F.coalesce(F.sum("redactions"), F.lit(0)).alias("count")).first().asDict()
        chosen = backends.select_model(self.backend.models(), provider, model, self.classifier)
        contract = "|".join([classify.contract_of(stage), chosen.provider, chosen.id])
        cache = self.cache.limit(0) if rescreen else self.cache
        split = tables.written(classify.cache_split(classify.fingerprints(red.drop("redactions"), contract), cache), "split")
        misses = split.where("cached_bucket IS NULL").count()
        held = not confirm and classify.preflight(misses, self.call_limit) != "ok"

        def score(missed: DataFrame) -> DataFrame:
            if held:
                return missed.select("ord", "id", F.lit("withheld").alias("bucket"), F.lit(None).cast("double").alias("probability"), F.lit("approval_required").alias("reason"))
            return backends.screened(missed, self.backend, stage, chosen, self.fraction)

        out = tables.written(classify.merge_hits(split, score), "outcomes")
        if not held:
            self.clock += 1
            fresh = split.select("id", "contract_fp", "candidate_fp").join(out.select("id", "bucket", "probability"), "id").select("contract_fp", "candidate_fp", "bucket", "probability", F.lit(self.clock).cast("long").alias("last_access"))
            self.cache = tables.written(classify.cache_write(self.cache, fresh, self.cache_size), "cache")
        called = 0 if held else out.where("NOT hit AND NOT (bucket = 'withheld' AND reason = 'too_large')").count()
        return Screen(out, {**replaced, "total": total}, called, chosen)

    def screen(self, items: DataFrame, question: str, confirm: bool = False, rescreen: bool = False, provider: str | None = None, model: str | None = None, **limits) -> Screen:
        """The ad-hoc batch of (ord, id, text)."""
        if not question.strip():
            raise ContractError("the question is empty")
        return self._screen(items, contracts.Stage(question, contracts.YES, contracts.NO, contracts.thresholds(**limits)), confirm, rescreen, provider, model)

    @staticmethod
    def summary(screen: Screen) -> dict:
        """Counts by bucket, the run's status, and what was redacted."""
        n = classify.summary(screen.outcomes).first().asDict()
        return {**n, "status": backends.status(n), "redaction_items": screen.redaction["items"], "redaction_count": screen.redaction["count"]}

    def primary(self, preset: contracts.Preset, scope: str | DataFrame, confirm: bool = False, defer_review: bool = False, rescreen: bool = False) -> str:
        found = self.discover(preset, scope)
        if found.status != "ok":
            raise ContractError(found.issues[0])
        screen = self._screen(found.rows.select("ord", "id", "text"), preset.primary, confirm, rescreen)
        if screen.outcomes.where("reason = 'approval_required'").limit(1).count():
            raise ContractError("approval_required")
        name = f"primary-{len(self.runs) + 1}"
        self.runs[name] = Run(preset, scope, found.rows, screen)
        if not defer_review:
            self.runs[name].review_id = self.review_start(name)
        return name

    def _run(self, name: str) -> Run:
        if name not in self.runs:
            raise ContractError(f"no run {name}")
        return self.runs[name]

    def manifest(self, name: str, labels: tuple[str, ...] = (), offset: int = 0, limit: int = 200) -> DataFrame:
        run = self._run(name)
        places = run.candidates if "column" in run.candidates.columns else run.candidates.withColumn("column", F.lit(1))
        return classify.page(classify.manifest(run.outcomes, run.preset.primary.thresholds, labels, places), ["ord"], offset, limit)

    def efficiency(self, name: str) -> dict:
        run = self._run(name)
        return classify.efficiency(run.outcomes, F.col("hit")).first().asDict() | {"primary_evaluated": run.primary.evaluated}

    def refine(self, name: str, confirm: bool = False, rescreen: bool = False) -> dict:
        """A second pass over the retained candidates; once done it stands, unless screened again."""
        run = self._run(name)
        if run.preset.refinement is None:
            raise ContractError("the preset has no refinement")
        if run.review_id and self.reviews[run.review_id].decided:
            raise ContractError("the run is under review")
        kept = classify.retained(run.outcomes).select("id").join(run.candidates.select("ord", "id", "text"), "id")
        if run.refined is None or rescreen:
            run.refined = self._screen(kept.select("ord", "id", "text"), run.preset.refinement, confirm, rescreen)
        n, dropped = run.refined.outcomes.agg(F.count(F.lit(1)), F.count_if(F.col("bucket") == "dropped")).first()
        share = dropped / n if n else 0.0
        return {"retained": n, "dropped": dropped, "yield": share, "low_yield": share < 0.30}

    # evidence and review

    def evidence(self, preset: contracts.Preset, scope: str | DataFrame, ids: list[str], detail: str = "standard", budget: Budget | None = None) -> dict:
        """A packet of evidence on ``ids``, in their order: items, counts, and which bound cut it. Stale ids make an error."""
        if detail not in DETAILS:
            raise ContractError(f"detail is one of {DETAILS}")
        b = budget or preset.budget
        found = providers.guarded(lambda: self.registry.resolve(preset).evidence(self.spark, scope, ids, b, detail))
        if found.status != "ok":
            return {"status": "error", "packet_ids": [], "items": [], "source_count": 0, "chars": 0, "requested": len(ids), "trim_reason": "none", "issues": found.issues}
        kept = [r.asDict() for r in evidence.token_bounded(found.rows, b).orderBy("ord").select("id", "source", "evidence").collect()]  # at most max_items
        if self.packet_builder:
            kept = self.packet_builder(kept)
            if not {i["id"] for i in kept} <= set(ids):
                raise ContractError("the packet has items that weren't asked for")
        return {"status": "ok", "packet_ids": [i["id"] for i in kept], "items": kept, "source_count": len({i["source"] for i in kept}), "chars": sum(len(i["evidence"]) for i in kept), "requested": len(ids), "trim_reason": trimmed(len(ids), found.total, len(kept)), "issues": []}

    def review_apply(self, preset: contracts.Preset, detail: str, packet_ids: list[str], decisions: list[tuple[str, str, str]]) -> dict:
        """What decisions on a packet come to, without any review: all of them apply or none."""
        known = {d.id: d for d in preset.dispositions}
        given = [d[0] for d in decisions]
        if detail not in DETAILS or len(set(packet_ids)) != len(packet_ids) or sorted(given) != sorted(packet_ids) or any(d[1] not in known or not d[2].strip() for d in decisions):
            raise ContractError("decisions cover the packet exactly, with known dispositions and a rationale each")
        open_ = [i for i, d, _ in decisions if not known[d].terminal]
        return {
            "reviewed": [i for i, d, _ in decisions if known[d].terminal], "findings": [i for i, d, _ in decisions if known[d].finding], "needs_expanded": open_ if detail == "standard" else [], "blocked": open_ if detail == "expanded" else [],
            "counts": {x: sum(d[1] == x for d in decisions) for x in known},
        }

    def review_start(self, name: str, ids: list[str] | None = None) -> str:
        run = self._run(name)
        if ids is not None:
            if len(set(ids)) != len(ids) or any(not t.strip() for t in ids):
                raise ContractError("review targets are unique and not blank")
            kept = self.spark.createDataFrame(list(enumerate(ids)), "ord int, target string").select("target", F.col("ord").cast("long").alias("ord"))
        else:
            rows = classify.retained((run.refined or run.primary).outcomes)
            kept = tables.ranked(rows.select(F.col("id").alias("target"), "bucket_rank", F.col("ord").alias("_o")), ["bucket_rank", "_o"], "ord", "targets").select("target", "ord")
        name = f"review-{len(self.reviews) + 1}"
        self.reviews[name] = Review(run.preset, run.scope, tables.written(kept, "targets"), tables.new_path(self.spark, "decisions"))
        return name

    def _review(self, name: str | None) -> tuple[str, Review]:
        if not self.reviews or (name and name not in self.reviews):
            raise ContractError("no such review")
        name = name or list(self.reviews)[-1]
        return name, self.reviews[name]

    def _decisions(self, r: Review) -> DataFrame:
        log = self.spark.read.schema(DECISION).parquet(r.log) if r.decided else self.spark.createDataFrame([], DECISION)
        return log.withColumnRenamed("id", "target")

    def _used(self, r: Review) -> DataFrame:
        return review.attempts(self._decisions(r), ["n"])

    def _states(self, r: Review) -> DataFrame:
        return review.states(r.targets.select("target"), self._used(r))

    def review_next(self, name: str | None = None) -> dict:
        """The pending packet, or the next: expanded targets first. ``terminal`` once all is reviewed or blocked."""
        name, r = self._review(name)
        if r.pending:
            return r.pending
        open_ = self._states(r).where(F.col("state").isin("pending", "needs_expanded")).join(r.targets, "target")
        first = open_.withColumn("late", F.col("state") == "pending").orderBy("late", "ord").limit(r.preset.budget.target_items).collect()  # one packet
        if not first:
            blocked = self._states(r).where("state = 'blocked'").limit(1).count()
            return {"terminal": True, "status": "review_complete_with_blocked_evidence" if blocked else "review_complete"}
        detail = "standard" if first[0]["late"] else "expanded"
        ids = [x["target"] for x in first if x["late"] == first[0]["late"]]
        packet = self.evidence(r.preset, r.scope, ids, detail)
        if packet["status"] != "ok":
            raise ContractError(packet["issues"][0])
        if not packet["items"]:
            raise ContractError("the first item is beyond the packet's bounds")
        r.packets += 1
        r.pending = {"terminal": False, "packet_id": f"{name}:p{r.packets}", "detail": detail, "items": packet["items"], "trim_reason": packet["trim_reason"]}
        return r.pending

    def review_commit(self, packet_id: str, decisions: list[tuple[str, str, str]], name: str | None = None) -> dict:
        """Apply all decisions on the pending packet, or none."""
        name, r = self._review(name)
        if not r.pending or r.pending["packet_id"] != packet_id:
            raise ContractError("the packet is not pending")
        self.review_apply(r.preset, r.pending["detail"], [i["id"] for i in r.pending["items"]], decisions)
        rows = [(i, r.pending["detail"], d, why.strip(), r.decided + k) for k, (i, d, why) in enumerate(decisions)]
        self.spark.createDataFrame(rows, DECISION).coalesce(1).write.mode("overwrite").parquet(f"{r.log}/packet={r.packets}")
        r.decided += len(rows)
        r.pending = None
        return self.review_progress(name)

    def review_progress(self, name: str | None = None) -> dict:
        _, r = self._review(name)
        return review.progress(self._states(r), self._used(r)).first().asDict()

    def dispositions(self, name: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Decisions and final dispositions by the contract's dispositions, zero where there are none."""
        _, r = self._review(name)
        contract = review.contract_table(self.spark, r.preset.dispositions)
        return review.disposition_counts(contract, self._used(r)), review.disposition_counts(contract, self._states(r), "final_disposition")

    def blocked(self, name: str | None = None) -> DataFrame:
        """(target, rationale) of what even expanded evidence didn't settle."""
        _, r = self._review(name)
        return self._states(r).where("state = 'blocked'").select("target").join(self._decisions(r).where("detail = 'expanded'").select("target", "rationale"), "target")


def trimmed(requested: int, provided: int, kept: int) -> str:
    """Which bound cut a packet: the provider's, the tokens, both or none."""
    provider, tokens = provided < requested, kept < provided
    return "both" if provider and tokens else "adapter_bounds" if provider else "token_budget" if tokens else "none"
