"""Candidates by pattern: exact offsets, lines, columns, stable ids and line windows, as column expressions. Offsets, columns and the
hash count UTF-16 code units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import contracts
from siftwell.functions.patterns import glob_regex, java_regex, literal_regex, may_be_empty, python_regex
from siftwell.operators import tables
from siftwell.operators.redaction import let


def included(path: Column, include: tuple[str, ...], exclude: tuple[str, ...] = (), skip_dirs: tuple[str, ...] = ()) -> Column:
    """Any include, no exclude, no skipped folder on the way."""
    hit = F.lit(False)
    for g in include:
        hit = hit | path.rlike(glob_regex(g))
    for g in exclude:
        hit = hit & ~path.rlike(glob_regex(g))
    if skip_dirs:
        parts = F.split(path, "/")
        hit = hit & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in skip_dirs]))
    return hit


def pattern_regex(p: contracts.Pattern) -> str:
    return literal_regex(p.regex) if p.literal else java_regex(p.regex, p.flags)


def units(text: Column) -> Column:
    """The text's length in UTF-16 code units, which offsets and columns count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


#: Matches to a chunk, within which positions are summed one by one.
CHUNK = 256
_MOVE = "struct<off:int,line:int,tail:int>"


def _moved(a: Column, b: Column) -> Column:
    """Where a piece of text ``b`` (its length, line ends, length after the last of them) leads from ``a``."""
    return F.struct((a["off"] + b["off"]).cast("int").alias("off"), (a["line"] + b["line"]).cast("int").alias("line"), F.when(b["line"] > 0, b["tail"]).otherwise(a["tail"] + b["tail"]).cast("int").alias("tail"))


def _piece(text: Column) -> Column:
    lines = F.regexp_count(text, F.lit("\n"))
    return F.struct(units(text).alias("off"), lines.cast("int").alias("line"), units(F.substring_index(text, "\n", -1)).alias("tail"))


def _running(pieces: Column) -> Column:
    """Running sums of an array of pieces by :func:`_moved`: in chunks, then over the chunks, so that the work is far from quadratic."""
    none = F.struct(F.lit(0).alias("off"), F.lit(0).alias("line"), F.lit(0).alias("tail"))
    empty = F.array().cast(f"array<{_MOVE}>")

    def fold(items: Column) -> Column:
        grow = lambda acc, x: let(_moved(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))
        return F.aggregate(items, F.struct(none.alias("at"), empty.alias("out")), grow, lambda acc: acc["out"])

    count = F.ceil(F.size(pieces) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: fold(F.slice(pieces, c * CHUNK + 1, F.lit(CHUNK))))

    def joined(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: _moved(F.get(e, i - 1), x))))))

    return F.when(F.size(pieces) == 0, empty).otherwise(let(chunks, joined))


def _solid(text: Column, regex: str) -> Column:
    """Matches of a pattern that always takes a character: ARRAY<STRUCT<off, line, column, m>>. Pieces are the gaps that ``split``
    leaves, each with the match behind it."""

    def found(m: Column) -> Column:
        gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(m))
        pairs = F.arrays_zip(gaps.alias("g"), m.alias("m"))
        ends = _running(F.transform(pairs, lambda x: _moved(_piece(x["g"]), _piece(x["m"]))))
        # a match starts where the piece before it ended, moved by the gap
        none = F.struct(F.lit(0).alias("off"), F.lit(0).alias("line"), F.lit(0).alias("tail"))
        start = lambda e, x, i: let(_moved(F.when(i == 0, none).otherwise(F.get(e, i - 1)), _piece(x["g"])), lambda s: F.struct(s["off"].alias("off"), (s["line"] + 1).alias("line"), (s["tail"] + 1).alias("column"), x["m"].alias("m")))
        return let(ends, lambda e: F.transform(pairs, lambda x, i: start(e, x, i)))

    none = F.array().cast("array<struct<off:int,line:int,column:int,m:string>>")
    return F.when(text.rlike(regex), let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), found)).otherwise(none)


HITS = "array<struct<off:int,line:int,column:int,m:string>>"


def _python_source(pattern: contracts.Pattern) -> str:
    return re.escape(pattern.regex) if pattern.literal else python_regex(pattern.regex, pattern.flags)


def _empty_hits(pattern: contracts.Pattern):
    """A function on Arrow batches for a pattern that may match nothing: after such a match the search moves on by one code unit."""
    source = _python_source(pattern)

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        find = re.compile(source).finditer

        def one(text: str | None) -> list[dict]:
            out, at, off, line, start = [], 0, 0, 1, 0
            for m in find(text or ""):
                gap = text[at : m.start()]
                off, at = off + len(gap) + sum(c > "￿" for c in gap), m.start()
                if n := gap.count("\n"):
                    last = gap[gap.rindex("\n") + 1 :]
                    line, start = line + n, off - len(last) - sum(c > "￿" for c in last)
                out.append({"off": off, "line": line, "column": off - start + 1, "m": m[0]})
            return out

        return texts.map(one)

    return hits


def _empty_count(pattern: contracts.Pattern):
    """How many matches :func:`_empty_hits` has, which may be more than characters, one at a time: none is kept."""
    source = _python_source(pattern)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        find = re.compile(source).finditer
        return pd.Series([sum(1 for _ in find(text or "")) for text in texts], dtype="int64")

    return count


def short_hash(text: Column) -> Column:
    """Twelve hex digits of a two-lane 32-bit multiply and xor over UTF-16 code units."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    codes = F.transform(F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    mask = F.lit(0xFFFFFFFF)

    def lane(codes: Column, seed: int, factor: int) -> Column:
        h = F.aggregate(codes, F.lit(seed).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(factor).cast("long")).bitwiseAND(mask))
        return F.lpad(F.lower(F.hex(h)), 8, "0")

    both = lambda c: F.concat(lane(c, 0x811C9DC5, 0x01000193), lane(c, 0x9E3779B9, -2048144789))
    return F.substring(let(F.when(text == "", F.array().cast("array<bigint>")).otherwise(codes), both), 1, 12)


def _cut(text: Column, most: int) -> Column:
    """At most ``most`` UTF-16 code units; a pair isn't cut in two."""
    short = F.substring(text, 1, most)
    over = let(F.transform(F.split(short, ""), lambda c: units(c)), lambda u: F.aggregate(u, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, x: F.when(a["n"] + x <= most, F.struct((a["n"] + x).alias("n"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(most).alias("n"), a["k"].alias("k"))), lambda a: a["k"]))
    return F.when(units(short) <= most, short).otherwise(F.substring(short, F.lit(1), over))


def line_window(lines: Column, line: Column, window: contracts.Window) -> Column:
    """Numbered lines around a match, the match's own marked, cut to the window's characters."""
    first = F.greatest(F.lit(1), line - window.before)
    last = F.least(F.size(lines), line + window.after)
    shown = F.transform(F.sequence(first, last), lambda i: F.concat(F.when(i == line, ">").otherwise(" "), F.lpad(i.cast("string"), F.greatest(F.lit(5), F.length(i.cast("string"))), F.lit(" ")), F.lit(" | "), F.element_at(lines, i)))
    return let(F.array_join(shown, "\n"), lambda text: F.when(units(text) <= window.chars, text).otherwise(F.concat(_cut(text, max(0, window.chars - 24)), F.lit("\n[window truncated]"))))


def located(files: DataFrame, patterns: tuple[contracts.Pattern, ...], windows: dict[str, contracts.Window] | None = None) -> DataFrame:
    """(source, pattern_id, pattern_label, off, match_text, line, column, and a column for each of ``windows``): a row per match.

    One scan for all patterns: each gives an array of matches, with lines, columns and windows made inside the array, and one
    explode brings out small rows only. Patterns that can match nothing run in Python on Arrow batches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hits, by_python = [], files.select("source", text.alias("text"))
    for k, p in enumerate(patterns):
        if not p.literal and may_be_empty(p.regex):
            by_python = by_python.withColumn(f"_hits{k}", _empty_hits(p)(F.col("text")))
            hits.append(F.col(f"_hits{k}"))
        else:
            hits.append(_solid(F.col("text"), pattern_regex(p)))
    named = [_named(h, p) for h, p in zip(hits, patterns)]
    found = by_python.select("source", "text", F.explode_outer(F.array(F.flatten(F.array(*named)))).alias("hits")).where(F.size("hits") > 0)
    fields = ("pattern_id", "pattern_label", "off", "match_text", "line", "column")
    if windows:
        lined = found.select("source", "hits", F.explode_outer(F.array(F.split("text", "\r?\n", -1))).alias("lines"))
        shown = lambda x: F.struct(*[x[f].alias(f) for f in fields], *[line_window(F.col("lines"), x["line"], w).alias(name) for name, w in windows.items()])
        found = lined.select("source", F.transform("hits", shown).alias("hits"))
    return found.select("source", F.explode("hits").alias("x")).select("source", *[F.col(f"x.{f}").alias(f) for f in (*fields, *(windows or {}))])


def _named(hits: Column, p: contracts.Pattern) -> Column:
    return F.transform(hits, lambda x: F.struct(F.lit(p.id).alias("pattern_id"), F.lit(p.label).alias("pattern_label"), x["off"].alias("off"), x["m"].alias("match_text"), x["line"].alias("line"), x["column"].alias("column")))


def matches(files: DataFrame, pattern: contracts.Pattern) -> DataFrame:
    """(source, pattern_id, pattern_label, off, match_text, line, column) of one pattern."""
    return located(files, (pattern,))


def counts(files: DataFrame, patterns: tuple[contracts.Pattern, ...]) -> DataFrame:
    """(pattern_id, n) without places: matches are counted in the text."""
    text, each = F.coalesce(F.col("text"), F.lit("")), []
    for p in patterns:
        n = _empty_count(p)(text) if not p.literal and may_be_empty(p.regex) else F.regexp_count(text, F.lit(pattern_regex(p)))
        each.append(F.struct(F.lit(p.id).alias("pattern_id"), n.cast("long").alias("n")))
    return files.select(F.explode(F.array(*each)).alias("x")).where("x.n > 0").groupBy("x.pattern_id").agg(F.sum("x.n").alias("n"))


def candidates(files: DataFrame, source: contracts.Source, check: bool = False, windows: dict[str, contracts.Window] | None = None) -> DataFrame:
    """(id, text, source, line, column, pattern_id, pattern_label, off, match_text) of (source, text) files, and further line
    windows by name. ``check`` first counts files, their sizes and candidates and raises beyond the limits, so a screen is whole or
    not at all."""
    wanted = files.where(included(F.col("source"), source.include, source.exclude, source.skip_dirs))
    if check:
        n, longest = wanted.agg(F.count(F.lit(1)), F.max(F.octet_length("text"))).first()
        if n > source.limits.files or (longest or 0) > source.limits.file_bytes:
            raise contracts.ContractError(f"{n} files, the longest of {longest} bytes, are beyond the limits")
    rows = located(wanted, source.patterns, {"_snippet": source.snippet} | (windows or {}))
    digest = short_hash(F.concat(F.col("pattern_id"), F.lit("\0"), F.col("match_text")))
    id_ = F.concat_ws(":", F.lit("gs"), "pattern_id", "source", F.col("line").cast("string"), F.col("column").cast("string"), digest)
    shown = F.concat_ws("\n", F.concat(F.lit("source="), "source"), F.concat(F.lit("pattern="), "pattern_label"), F.concat(F.lit("location="), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string")), "_snippet")
    out = rows.select(id_.alias("id"), shown.alias("text"), "source", "line", "column", "pattern_id", "pattern_label", "off", "match_text", *(windows or {}))
    if check and located(wanted, source.patterns).count() > source.limits.candidates:
        raise contracts.ContractError("more candidates than the limit")
    return out


def in_order(found: DataFrame) -> DataFrame:
    """With ``ord``: by source as people sort names, then offset, pattern and id. ``found`` is written first: a range shuffle reads its
    rows twice, and the texts are to be scanned once."""
    return tables.ranked(tables.written(found, "found").withColumn("_s", F.expr("source COLLATE UNICODE")), ["_s", "off", "pattern_id", "id"], "ord", "candidates").drop("_s")
