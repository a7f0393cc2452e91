"""Credential redaction: seven rules in sequence as column expressions, each replacement counted.

A rule runs only on texts that hold one of its anchors, plain substrings that every match needs; no replacement makes an anchor that a
later rule could use, so the anchors are looked up once in the text as it came. Every intermediate text is bound once (see :func:`let`),
so the plan has each replacement and each count once, and :func:`redacted` keeps the optimizer from copying the chain into filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.patterns import WORD_EDGE as EDGE

_PEM = r"-----{} (?:[A-Z0-9]+ )?PRIVATE KEY-----"
_NAMES = "|".join(["api[_-]?key", *(f"{x}[_-]?token" for x in ("access", "auth")), "token", "secret", "passw(?:or)?d", "client[_-]?secret", "credential"])
_NAMED = rf"(?i){EDGE}((?:{_NAMES})){EDGE}(\s*[:=]\s*)"
_CALLED = ("key", "token", "secret", "passw", "credential")
#: (pattern, replacement, anchors, whether these are in lower case).
RULES: tuple[tuple[str, str, tuple[str, ...], bool], ...] = (
    (_PEM.format("BEGIN") + r"[\s\S]*?" + _PEM.format("END"), "[REDACTED_PRIVATE_KEY]", ("PRIVATE KEY-----",), False),
    (rf"(?i){EDGE}Bearer\s+[-\w.~+/]{{12,}}={{0,2}}", "Bearer [REDACTED]", ("bearer",), True),
    (rf"{EDGE}(?:sk-(?:ant-)?|gh[oprsu]_|github_pat_|xox[abprs]-)[-\w.]{{12,}}{EDGE}", "[REDACTED_TOKEN]", ("sk-", *(f"gh{c}_" for c in "oprsu"), "github_pat_", *(f"xox{c}-" for c in "abprs")), False),
    (rf"{EDGE}AKIA[0-9A-Z]{{16}}{EDGE}", "[REDACTED_AWS_ACCESS_KEY]", ("AKIA",), False),
    (rf"{EDGE}AIza[-\w]{{30,}}{EDGE}", "[REDACTED_API_KEY]", ("AIza",), False),
    (_NAMED + r"([\"'])([^\"'\r\n]{6,})\3", "$1$2$3[REDACTED]$3", _CALLED, True),
    (_NAMED + r"([^\s,;]{8,})", "$1$2[REDACTED]", _CALLED, True),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def redact(text: Column) -> Column:
    """STRUCT<text, count>; the count of a rule is taken before its replacement."""

    def flags(low: Column) -> Column:
        found = []
        for _, _, anchors, lower in RULES:
            hit = F.lit(False)
            for a in anchors:
                hit = hit | F.contains(low if lower else text, F.lit(a))
            found.append(hit)
        return F.array(*found)

    def step(wanted: Column, pattern: str, to: str) -> Callable[[Column], Column]:
        done = lambda s: F.struct(F.regexp_replace(s["text"], pattern, to).alias("text"), (s["count"] + F.regexp_count(s["text"], F.lit(pattern))).cast("long").alias("count"))
        return lambda s: F.when(wanted, done(s)).otherwise(s)

    def chain(on: Column) -> Column:
        now = F.struct(text.alias("text"), F.lit(0).cast("long").alias("count"))
        for i, (pattern, to, _, _) in enumerate(RULES):
            now = let(now, step(on[i], pattern, to))
        return now

    return let(let(F.lower(text), flags), chain)


def redacted(rows: DataFrame, column: str = "text", count: str = "redactions") -> DataFrame:
    """``rows`` with the column redacted and the number of replacements added. The chain is computed once a row: it is generated,
    so no later filter or projection takes it in."""
    made, name = "_redacted", column
    out = rows.select("*", F.explode_outer(F.array(redact(F.col(f"`{column}`")))).alias(made))
    kept = [F.col(f"{made}.text").alias(name) if c == column else F.col(f"`{c}`") for c in rows.columns]
    return out.select(*kept, F.col(f"{made}.count").alias(count))
