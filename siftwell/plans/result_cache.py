"""Whole results of a screen, kept for a few inputs: a second run of the same question over the same items returns the same table."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.contracts import Stage
from siftwell.operators import backends, classify, tables

ENTRIES = 4


def items_digest(items: DataFrame) -> str:
    """A digest of all (ord, id, text) rows in any order, by two sums of hashes."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), "ord", "id", text).cast("decimal(38,0)"))
    return "|".join(map(str, items.agg(F.count(F.lit(1)), one("a"), one("b")).first()))


class ResultCache:
    """The last ``entries`` results used. Only runs with status ``ok`` are kept; ``rescreen`` runs again and replaces."""

    def __init__(self, entries: int = ENTRIES) -> None:
        self.entries, self._kept = entries, OrderedDict()

    def screened(self, items: DataFrame, stage: Stage, model: backends.Model, run: Callable[[], DataFrame], confirm: bool = False, rescreen: bool = False) -> tuple[DataFrame, bool]:
        """(outcomes, whether they were kept ones)."""
        contract = [classify.contract_of(stage), model.provider, model.id, str(confirm), items_digest(items)]
        key = hashlib.sha256("\x1f".join(contract).encode()).hexdigest()
        if not rescreen and key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key], True
        out = tables.written(run(), "result")
        if backends.status(classify.summary(out).first().asDict()) == "ok" and not out.where("reason = 'approval_required'").limit(1).count():
            self._kept[key] = out
            self._kept.move_to_end(key)
            while len(self._kept) > self.entries:
                self._kept.popitem(last=False)
        return out, False
