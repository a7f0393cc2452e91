"""Thresholds, criteria, presets and review contracts: plain values on the driver, checked when made."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

YES = "The text plausibly satisfies the question."
NO = "The text clearly does not satisfy the question."
GUARD = "Answer no only if the text itself rules it out; what it doesn't show is not a reason."
HINTS = "These hints are examples to weigh, not rules: "
ID = re.compile(r"[A-Z][A-Z0-9_]{0,63}")


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Thresholds:
    keep: float
    drop: float


def thresholds(threshold: float | None = None, keep: float | None = None, drop: float | None = None) -> Thresholds:
    """keep lies in (0.5, 1], drop in [0, 0.5). A lone ``threshold`` is symmetric; keep alone leaves drop where it is."""
    if threshold is not None and keep is not None and threshold != keep:
        raise ContractError("threshold and keep threshold differ")
    k = keep if keep is not None else threshold if threshold is not None else 0.7
    d = drop if drop is not None else 1.0 - threshold if threshold is not None else 1.0 - 0.7
    if not 0.5 < k <= 1:
        raise ContractError("the keep threshold lies above 0.5 and at most at 1")
    if not 0 <= d < 0.5:
        raise ContractError("the drop threshold lies at 0 or above and below 0.5")
    return Thresholds(float(k), float(d))


@dataclass(frozen=True)
class Pattern:
    id: str
    label: str
    regex: str
    flags: str = ""
    literal: bool = False


@dataclass(frozen=True)
class Window:
    before: int
    after: int
    chars: int

    def __post_init__(self) -> None:
        if not (0 <= self.before <= 500 and 0 <= self.after <= 500 and 1 <= self.chars <= 200_000):
            raise ContractError("window out of bounds")


@dataclass(frozen=True)
class Limits:
    files: int = 10_000
    file_bytes: int = 1_000_000
    candidates: int = 100_000

    def __post_init__(self) -> None:
        if not (1 <= self.files <= 100_000 and 1 <= self.file_bytes <= 20_000_000 and 1 <= self.candidates <= 1_000_000):
            raise ContractError("limits out of bounds")


@dataclass(frozen=True)
class Source:
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    skip_dirs: tuple[str, ...] = (".git", ".hg", ".svn")
    patterns: tuple[Pattern, ...] = ()
    snippet: Window = Window(1, 4, 3000)
    standard: Window = Window(4, 12, 10_000)
    expanded: Window = Window(12, 36, 24_000)
    limits: Limits = Limits()


@dataclass(frozen=True)
class Disposition:
    id: str
    terminal: bool
    finding: bool
    description: str = ""


NEUTRAL = (
    Disposition("CONFIRM", True, True, "What is shown settles that the question holds."),
    Disposition("REJECT", True, False, "What is shown settles that the question does not hold."),
    Disposition("INSUFFICIENT_EVIDENCE", False, False, "What is shown settles neither; more is asked for."),
)


def review_contract(dispositions: tuple[Disposition, ...] = NEUTRAL) -> tuple[Disposition, ...]:
    ids = [d.id for d in dispositions]
    by = {d.id: d for d in dispositions}
    if len(ids) < 3 or len(set(ids)) != len(ids) or not all(ID.fullmatch(i) for i in ids):
        raise ContractError("a contract has three or more different disposition ids in upper case")
    if not ("CONFIRM" in by and by["CONFIRM"].terminal and by["CONFIRM"].finding):
        raise ContractError("CONFIRM is terminal and a finding")
    if "INSUFFICIENT_EVIDENCE" not in by or by["INSUFFICIENT_EVIDENCE"].terminal or by["INSUFFICIENT_EVIDENCE"].finding:
        raise ContractError("INSUFFICIENT_EVIDENCE is there and not terminal")
    if any(not d.description.strip() for d in dispositions):
        raise ContractError("every disposition has a description")
    if any(not d.terminal for d in dispositions if d.id != "INSUFFICIENT_EVIDENCE"):
        raise ContractError("only INSUFFICIENT_EVIDENCE is not terminal")
    if any(d.finding for d in dispositions if d.id != "CONFIRM"):
        raise ContractError("only CONFIRM is a finding")
    if not any(d.terminal and not d.finding for d in dispositions):
        raise ContractError("one disposition is terminal and no finding")
    return tuple(dispositions)


@dataclass(frozen=True)
class Stage:
    question: str
    yes: str
    no: str
    thresholds: Thresholds


@dataclass(frozen=True)
class Budget:
    target_items: int = 40
    max_items: int = 60
    max_sources: int = 10
    max_chars: int = 120_000
    max_tokens: int = 7200

    def __post_init__(self) -> None:
        if not (1 <= self.target_items <= self.max_items <= 500 and 1 <= self.max_sources <= 100 and 1000 <= self.max_chars <= 250_000 and 1000 <= self.max_tokens <= 20_000):
            raise ContractError("evidence budget out of bounds")


@dataclass(frozen=True)
class Preset:
    id: str
    label: str
    description: str
    provider: str
    source: Source | None
    primary: Stage
    refinement: Stage | None = None
    dispositions: tuple[Disposition, ...] = NEUTRAL
    budget: Budget = field(default_factory=Budget)


def _text(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ContractError(f"{name} is a non-empty string")
    return value.strip()


def _list(value: object) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _only(data: Mapping, allowed: set[str], name: str) -> None:
    if extra := set(data) - allowed:
        raise ContractError(f"{name} has unknown fields: {sorted(extra)}")


def _source(data: Mapping, windows: tuple[Window, Window, Window]) -> Source:
    include = tuple(_text(x, "include") for x in _list(data.get("include")))
    if not include:
        raise ContractError("source.include is needed")
    patterns = [Pattern(f"find-{i}", x, x, literal=True) for i, x in enumerate((_text(x, "find") for x in _list(data.get("find"))), 1)]
    for i, m in enumerate(_list(data.get("match")), 1):
        m = {"regex": m} if isinstance(m, str) else m
        regex = _text(m.get("regex"), "match.regex")
        patterns.append(Pattern(m.get("id", f"match-{i}"), m.get("label", regex), regex, m.get("flags", "")))
    if not patterns:
        raise ContractError("source.find or source.match is needed")
    if len({p.id for p in patterns}) != len(patterns):
        raise ContractError("pattern ids repeat")
    skip = tuple(dict.fromkeys([".git", ".hg", ".svn", *_list(data.get("skipDirs"))]))
    limits = data.get("limits") or {}
    return Source(include, tuple(_list(data.get("exclude"))), skip, tuple(patterns), *windows, Limits(limits.get("maxFiles", 10_000), limits.get("maxFileBytes", 1_000_000), limits.get("maxCandidates", 100_000)))


def _stage(data: Mapping) -> Stage:
    criteria = data.get("criteria") or {}
    hints = [_text(h, "dropHints") for h in _list(data.get("dropHints"))]
    if len(hints) > 8 or any(len(h) > 240 for h in hints):
        raise ContractError("at most eight drop hints of at most 240 characters")
    no = " ".join([criteria.get("false", NO), *([HINTS + "; ".join(hints) + "."] if hints else []), GUARD])
    given = [data.get(k) for k in ("threshold", "keepThreshold", "dropThreshold")]
    limits = thresholds(*given) if any(x is not None for x in given) else Thresholds(0.7, 0.2)
    return Stage(_text(data.get("question"), "question"), criteria.get("true", YES), no, limits)


def parse_preset(data: Mapping) -> Preset:
    """The simple form has ``source`` and ``question``; the advanced one ``provider``, ``primary``, ``review`` and so on."""
    simple = "source" in data or "question" in data
    name = _text(data.get("id"), "id")
    if simple:
        _only(data, {"id", "label", "description", "source", "question", "dropHints", "classifier", "review", "evidence"}, "preset")
        windows = (Window(1, 5, 3500), Window(5, 16, 12_000), Window(16, 48, 28_000))
        stage = _stage({**(data.get("classifier") or {}), "question": data.get("question"), "dropHints": data.get("dropHints")})
        source, provider, refinement = _source(data.get("source") or {}, windows), "generic-source", None
    else:
        _only(data, {"id", "label", "description", "provider", "adapter", "primary", "refinement", "review", "evidence"}, "preset")
        spec = data.get("provider") or {}
        kind = spec.get("kind")
        provider = "generic-source" if kind == "generic-source" or "config" in spec else spec.get("id") or data.get("adapter") or kind or "generic-source"
        source = _source(spec["config"], (Window(1, 4, 3000), Window(4, 12, 10_000), Window(12, 36, 24_000))) if "config" in spec else None
        stage = _stage(data.get("primary") or {})
        refinement = _stage(data["refinement"]) if data.get("refinement") else None
    chosen = (data.get("review") or {}).get("dispositions")
    dispositions = review_contract(tuple(Disposition(d["id"], bool(d["terminal"]), bool(d.get("finding")), d.get("description", "")) for d in chosen) if chosen else NEUTRAL)
    e = data.get("evidence") or {}
    budget = Budget(e.get("targetItems", 40), e.get("maxItems", 60), e.get("maxSources", 10), e.get("maxChars", 120_000), e.get("maxTokens", 7200))
    return Preset(name, data.get("label") or name, data.get("description", ""), provider, source, stage, refinement, dispositions, budget)


FALLBACKS = {
    "id": "script-fallbacks",
    "label": "Failure handlers in scripts",
    "source": {"include": ["**/*.js", "**/*.ts", "**/*.tsx"], "exclude": ["**/*.d.ts"], "match": [{"id": "catch-block", "label": "catch block", "regex": r"\bcatch\s*(?:\([^)]*\))?\s*\{"}, {"id": "catch-call", "label": "catch call", "regex": r"\.catch\s*\("}]},
    "question": "Might this handler let a failed operation pass for a valid result?",
    "dropHints": ["the handler throws again or returns a clear error", "it only cleans up or logs and puts nothing in the result's place"],
}


HANDLERS = {
    "id": "python-exceptions",
    "label": "Exception handlers in Python",
    "description": "Handlers that might let a failure pass for a normal, empty, default or partial result.",
    "provider": {"kind": "builtin", "id": "python-exceptions"},
    "primary": {
        "threshold": 0.70,
        "question": "Might this handler let a real failure pass for success, or for an empty, default or silently partial result?",
        "criteria": {"true": "What failed matters to callers, and they may go on without being told of it.", "false": "The failure is told or raised again, or it concerns only cleaning up, measuring, display, trying again or extras."},
    },
    "refinement": {
        "threshold": 0.75,
        "question": "Does the text itself show that the caught failure can change, lose or misplace a result or state that callers rely on, without their being told?",
        "criteria": {"true": "Operation, handler and what follows show such an effect on data, control or state.", "false": "What is shown is expected tidying of input, cleaning up, trying again, display, measuring, extras or a clear failure."},
    },
    "review": {
        "dispositions": [
            {"id": "CONFIRM", "terminal": True, "finding": True, "description": "A hidden failure changes what callers rely on."},
            {"id": "EXPLICIT_FAILURE", "terminal": True, "finding": False, "description": "The failure reaches the caller."},
            {"id": "UI_ONLY", "terminal": True, "finding": False, "description": "Only what is displayed changes."},
            {"id": "OPTIONAL_ENRICHMENT", "terminal": True, "finding": False, "description": "Only an extra is missing, and can't pass for the core."},
            {"id": "CLEANUP_RETRY_TELEMETRY", "terminal": True, "finding": False, "description": "Only cleaning up, trying again, logs or measures."},
            {"id": "EXPECTED_NORMALIZATION", "terminal": True, "finding": False, "description": "The contract permits it and it shows."},
            {"id": "NO_OUTWARD_EFFECT", "terminal": True, "finding": False, "description": "What is shown settles that nothing outward changes."},
            {"id": "INSUFFICIENT_EVIDENCE", "terminal": False, "finding": False, "description": "What is shown settles neither; more is asked for."},
        ]
    },
    "evidence": {"targetItems": 60, "maxItems": 80, "maxSources": 10, "maxChars": 120_000, "maxTokens": 7200},
}


def load_presets(*folders: str) -> dict[str, Preset]:
    """The built-in presets and those of the folders' JSON files; listing skips malformed files, the first of an id wins."""
    found = {data["id"]: parse_preset(data) for data in (FALLBACKS, HANDLERS)}
    for folder in folders:
        for path in sorted(Path(folder).glob("*.json")) if Path(folder).is_dir() else []:
            try:
                preset = load_preset(str(path))
            except (ContractError, ValueError):
                continue
            found.setdefault(preset.id, preset)
    return found


def load_preset(path: str) -> Preset:
    try:
        preset = parse_preset(json.loads(Path(path).read_text(encoding="utf-8")))
    except (ValueError, KeyError, TypeError, OSError) as error:
        raise ContractError(f"{path}: {error}") from error
    if preset.id != Path(path).stem:
        raise ContractError(f"{path}: its id is {preset.id}")
    return preset
