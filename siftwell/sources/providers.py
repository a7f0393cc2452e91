"""Evidence providers and their registry: what finds candidates in a scope, and evidence on those that are asked for.

A scope is a path or a table of (source, text). Whatever goes wrong inside a provider becomes a result with status ``error`` and one
issue, never part of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.contracts import Budget, ContractError, Preset, Source
from siftwell.operators import discovery, evidence, tables
from siftwell.sources import python_handlers, tree

API_VERSION, SHOWN_IDS = 1, 8


@dataclass
class Result:
    status: str
    total: int = 0
    rows: DataFrame | None = None
    issues: list[str] = field(default_factory=list)


class Provider(Protocol):
    api_version: int
    id: str
    label: str

    def discover(self, spark: SparkSession, scope: str | DataFrame) -> DataFrame:
        """(ord, id, text, source, line, ...) of all candidates."""

    def evidence(self, spark: SparkSession, scope: str | DataFrame, ids: list[str], budget: Budget, detail: str) -> DataFrame:
        """(ord, id, source, evidence) of those asked for, in that order, within the budget's items, sources and characters."""


@dataclass
class GenericProvider:
    """Patterns over files. The source's limits bound a folder, which the driver lists; a table is screened whole, however many rows,
    bytes and candidates it has."""

    source: Source
    id: str = "generic-source"
    label: str = "Patterns in files"
    api_version: int = API_VERSION

    def files(self, spark: SparkSession, scope: str | DataFrame) -> DataFrame:
        return scope if isinstance(scope, DataFrame) else tree.read_tree(spark, scope, self.source)

    def discover(self, spark: SparkSession, scope: str | DataFrame) -> DataFrame:
        return discovery.in_order(discovery.candidates(self.files(spark, scope), self.source, check=not isinstance(scope, DataFrame)))

    def count(self, spark: SparkSession, scope: str | DataFrame) -> int:
        files = self.files(spark, scope)
        wanted = files.where(discovery.included(F.col("source"), self.source.include, self.source.exclude, self.source.skip_dirs))
        return discovery.counts(wanted, self.source.patterns).agg(F.sum("n")).first()[0] or 0

    def evidence(self, spark: SparkSession, scope: str | DataFrame, ids: list[str], budget: Budget, detail: str) -> DataFrame:
        found = discovery.candidates(self.files(spark, scope), self.source, windows={"_window": evidence.window_of(self.source, detail)})
        rows = asked(found, ids)
        return evidence.packed(evidence.bodies(rows, detail), budget).select("ord", "id", "source", "evidence")


@dataclass
class PythonProvider:
    """Exception handlers in Python files."""

    id: str = "python-exceptions"
    label: str = "Python exception handlers"
    api_version: int = API_VERSION

    def files(self, spark: SparkSession, scope: str | DataFrame) -> DataFrame:
        return scope if isinstance(scope, DataFrame) else tree.read_tree(spark, scope, Source(("**/*.py", "*.py"), skip_dirs=tree.PYTHON_SKIP))

    def facts(self, spark: SparkSession, scope: str | DataFrame) -> DataFrame:
        """Files are parsed once; the facts are a table."""
        return python_handlers.whole(tables.written(python_handlers.parsed(self.files(spark, scope)), "facts"))

    def discover(self, spark: SparkSession, scope: str | DataFrame) -> DataFrame:
        return tables.ranked(python_handlers.discover(self.facts(spark, scope)), ["source", "line", "id"], "ord", "candidates")

    def count(self, spark: SparkSession, scope: str | DataFrame) -> int:
        return python_handlers.discover(self.facts(spark, scope)).count()

    def evidence(self, spark: SparkSession, scope: str | DataFrame, ids: list[str], budget: Budget, detail: str) -> DataFrame:
        for i in ids:
            python_handlers.parse_id(i)
        rows = asked(python_handlers.evidence(self.facts(spark, scope), detail), ids)
        # items and sources bind first; then characters, where a first item that is too long is cut
        few = evidence.packed(rows.withColumn("_whole", F.col("evidence")).withColumn("evidence", F.lit("")), budget)
        return evidence.packed(few.withColumn("evidence", F.col("_whole")).drop("_whole"), budget, clip_first=True).select("ord", "id", "source", "evidence")


def asked(found: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of ``found`` that ``ids`` ask for, numbered in that order; raises if some are not there any more."""
    if not ids or len(set(ids)) != len(ids) or any(not i.strip() for i in ids):
        raise ContractError("ids are given, not blank and different")
    want = found.sparkSession.createDataFrame(list(enumerate(ids)), "ord int, id string")
    rows = tables.written(found.drop("ord").join(F.broadcast(want), "id"), "asked")  # as few as the ids
    there = {r["id"] for r in rows.select("id").distinct().collect()}
    if stale := [i for i in ids if i not in there]:
        raise ContractError(f"{len(stale)} ids are stale: {', '.join(stale[:SHOWN_IDS])}")
    return rows


class Registry:
    """Providers by id; a preset's own source makes its generic provider."""

    def __init__(self) -> None:
        self._by: dict[str, Provider] = {}
        self.register(PythonProvider())

    def register(self, provider: Provider) -> None:
        if getattr(provider, "api_version", None) != API_VERSION:
            raise ContractError(f"a provider has api_version {API_VERSION}")
        if not all(isinstance(getattr(provider, x, None), str) and getattr(provider, x).strip() for x in ("id", "label")):
            raise ContractError("a provider has an id and a label")
        if not all(callable(getattr(provider, x, None)) for x in ("discover", "evidence")):
            raise ContractError("a provider has the functions discover and evidence")
        if provider.id in self._by or provider.id == "generic-source":
            raise ContractError(f"there is a provider {provider.id}")
        self._by[provider.id] = provider

    def get(self, name: str) -> Provider:
        if name not in self._by:
            raise ContractError(f"no provider {name}")
        return self._by[name]

    def list(self) -> list[tuple[str, str]]:
        return [(p.id, p.label) for _, p in sorted(self._by.items())]

    def resolve(self, preset: Preset) -> Provider:
        if preset.source is not None:
            return GenericProvider(preset.source)
        return self.get(preset.provider)


REGISTRY = Registry()
#: The older names.
get_adapter, list_adapters = REGISTRY.get, REGISTRY.list


def guarded(run: Callable[[], DataFrame]) -> Result:
    """The rows of a provider with their count, or an error result. The rows are written before they are counted, so a failure on
    the executors is an error result too."""
    try:
        rows = tables.written(run(), "provided")
        return Result("ok", rows.count(), rows)
    except (ContractError, OSError, ValueError, PySparkException) as error:
        return Result("error", issues=[str(error).split("\n")[0][:500]])
