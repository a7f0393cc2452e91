"""Classifier backends: which model, and scores of items by a Python function on the executors.

A function takes (question, text) and returns a probability, or raises. Each task runs a bounded number of calls at once. Exceptions
become rows, their messages cut, redacted and without the item's text; a file named when the run began aborts what is not yet called.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.contracts import ContractError, Stage
from siftwell.functions.patterns import python_rules
from siftwell.operators import classify, tables

MESSAGE_CHARS, CONCURRENCY = 500, 12
SCORED = "ord long, id string, stop_reason string, answer_type string, probability double, message string"
Call = Callable[[str, str], float]


@dataclass(frozen=True)
class Model:
    provider: str
    id: str
    context_window: int | None = None


class BackendError(RuntimeError):
    """Raised by a classifier to report a failed answer, not a crash."""


class Aborted(RuntimeError):
    """Raised by a classifier that was stopped."""


class Backend(Protocol):
    def models(self) -> list[Model]: ...

    def scored(self, items: DataFrame, stage: Stage, model: Model) -> DataFrame:
        """(ord, id, a, message) of (ord, id, text); rows may be missing."""


def select_model(available: list[Model], provider: str | None = None, model: str | None = None, preferred: str | None = None) -> Model:
    """The pair asked for, else the provider's first, else the model by id, else the preferred ``provider/model``, else the first."""
    if not provider and not model and preferred and preferred.strip():
        provider, slash, model = preferred.strip().partition("/")
        if not (provider and slash and model):
            raise ContractError("the preferred classifier is given as provider/model")
    found = [m for m in available if (not provider or m.provider == provider) and (not model or m.id == model)]
    if not found:
        raise ContractError(f"no classifier model is available for {provider or 'any provider'}/{model or 'any model'}")
    return found[0]


def bounded_int(value: str | None, default: int, least: int, most: int) -> int:
    """A setting given as text; anything but a whole number within bounds is the default."""
    try:
        n = int((value or "").strip())
    except ValueError:
        return default
    return n if least <= n <= most else default


def safe_message(message: object, text: str = "") -> str:
    """At most MESSAGE_CHARS characters, redacted, the item's text taken out where it is that short."""
    rules = python_rules()
    clean = lambda x: _redacted(x, rules)
    out = clean(str(message)[:MESSAGE_CHARS])[:MESSAGE_CHARS]
    for part in (text, clean(text) if len(text) <= 4 * MESSAGE_CHARS else ""):
        if 0 < len(part) <= MESSAGE_CHARS:
            out = out.replace(part, "[ITEM_TEXT_REDACTED]")
    return out


def _redacted(text: str, rules: list[tuple[re.Pattern, str]]) -> str:
    for pattern, to in rules:
        text = pattern.sub(to, text)
    return text


@dataclass
class ColumnBackend:
    """Scores by a column expression, without Python on the executors."""

    scorer_of: Callable[[str], classify.Scorer] = classify.hash_scorer
    window: int | None = None

    def models(self) -> list[Model]:
        return [Model("columns", "expression", self.window)]

    def scored(self, items: DataFrame, stage: Stage, model: Model) -> DataFrame:
        scorer = self.scorer_of(classify.contract_of(stage))
        return classify.once(items, scorer(F.col("id"), F.col("text")), "a").select("ord", "id", "a", F.lit(None).cast("string").alias("message"))


@dataclass
class PythonBackend:
    """Scores by a Python function, ``concurrency`` calls at once in each task; ``abort`` names a file that stops the run."""

    call: Call
    available: tuple[Model, ...] = (Model("python", "function"),)
    concurrency: int = CONCURRENCY
    abort: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.concurrency <= 64:
            raise ContractError("concurrency lies between 1 and 64")

    def models(self) -> list[Model]:
        return list(self.available)

    def scored(self, items: DataFrame, stage: Stage, model: Model) -> DataFrame:
        call, question, most, abort = self.call, stage.question, self.concurrency, self.abort

        def stopped() -> bool:
            if abort is None:
                return False
            fs, at = pyarrow.fs.FileSystem.from_uri(abort) if "://" in abort else (pyarrow.fs.LocalFileSystem(), os.path.abspath(abort))
            return fs.get_file_info(at).type != pyarrow.fs.FileType.NotFound

        def one(text: str) -> tuple[str, str, float | None, str | None]:
            if stopped():
                return "aborted", "bool", None, "aborted"
            try:
                answer = call(question, text)
            except Aborted as error:
                return "aborted", "bool", None, safe_message(error, text)
            except BackendError as error:
                return "error", "bool", None, safe_message(error, text)
            except Exception as error:  # whatever a classifier raises becomes the item's row
                return "exception", "bool", None, safe_message(error, text)
            number = isinstance(answer, (int, float)) and not isinstance(answer, bool)
            return "stop", "bool" if number else type(answer).__name__, float(answer) if number else None, None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                with ThreadPoolExecutor(max(1, min(most, len(pdf)))) as pool:
                    rows = list(pool.map(one, pdf["text"]))
                out = pd.DataFrame(rows, columns=["stop_reason", "answer_type", "probability", "message"])
                yield pd.concat([pdf[["ord", "id"]].reset_index(drop=True), out], axis=1)

        rows = items.select(F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id"), "text").mapInPandas(run, SCORED)
        answered = tables.written(rows, "answers")  # each item is called once, whatever reads the outcome
        return answered.select("ord", "id", F.struct("stop_reason", "answer_type", "probability").alias("a"), "message")


def screened(items: DataFrame, backend: Backend, stage: Stage, model: Model, fraction: float = 0.85, overhead: int = 0) -> DataFrame:
    """Outcomes of (ord, id, text) by a backend. Items beyond the model's window are withheld and not called; an item without an
    answer row counts as an exception."""
    large = classify.too_large(F.col("text"), model.context_window, fraction, overhead)
    fit, out = items.where(~large), items.where(large).select("ord", "id", F.lit(True).alias("large"), F.lit(None).cast("struct<stop_reason:string,answer_type:string,probability:double>").alias("a"), F.lit(None).cast("string").alias("message"))
    answers = backend.scored(fit, stage, model)
    if not isinstance(backend, ColumnBackend):  # whose rows can't be missing
        answers = fit.select("ord", "id").join(answers.drop("ord"), "id", "left")
    answers = answers.select("ord", "id", F.lit(False).alias("large"), "a", "message")
    return classify.bucketed(answers.unionByName(out) if model.context_window else answers, stage.thresholds)


def status(summary: dict[str, int]) -> str:
    """``error`` if all that came of a run are errors, else ``ok``."""
    others = sum(summary[b] for b in classify.BUCKETS if b != "errors")
    return "error" if summary["errors"] and not others else "ok"

