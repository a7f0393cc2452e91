"""Chat formatting by incremental black-box rendering.

A renderer is any function from a list of (role, text) turns to one string. Nothing is known of it but its outputs: rendering
the successive prefixes of a conversation and comparing consecutive outputs gives each turn's span, and shows a template that
rewrites history (an output that does not begin with the one before). A mark in place of a turn's text then shows where in the
span the text lies. Spans of a rewriting template are found by such marks in the whole output, turn by turn. Marks are characters
that no turn of the conversation holds, and two of them must agree on the place.

The built-in template writes ``<|turn:role|>``, line end, text, ``<|end|>``, line end. Control strings inside texts are escaped
reversibly: every escape character is doubled, and after the first character of a control string one is put in.

Turns are rows ordered by turn (null first), then role, then text; ties and repeated rows are all kept. Null texts and roles count as
empty. Rows without conv_id form one conversation. An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ESCAPE = "␛"
#: Strings that steer common chat templates; none is left in an escaped text.
CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>)")
Turn = tuple[str, str]
Renderer = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE + ESCAPE))


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


def render(turns: list[Turn]) -> str:
    return "".join([f"<|turn:{escape(role)}|>\n{escape(text)}<|end|>\n" for role, text in turns])


@dataclass
class Formatted:
    text: str
    spans: list[tuple[int, int]]  # of each turn in text
    bodies: list[tuple[int, int]]  # of each turn's text in text
    rewrites: bool


def marks(turns: list[Turn]) -> list[str]:
    """Two characters that ``turns`` don't hold: private ones, or any others where all of those are used."""
    used = set().union(*map(set, (x for turn in turns for x in turn)))
    ranges = (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE), range(0x21, 0xD800))
    found = list(islice((c for r in ranges for c in map(chr, r) if c not in used), 2))
    if len(found) < 2:
        raise ValueError("the conversation holds every character")
    return found


def _place(turns: list[Turn], k: int, whole: str, renderer: Renderer, two: list[str], start: int = 0) -> tuple[int, int] | None:
    """Where in ``whole``, the rendering of ``turns``, the text of turn ``k`` lies, from ``start`` on; None if marks don't show it."""
    spots = set()
    for mark in two:
        marked = renderer([*turns[:k], (turns[k][0], mark), *turns[k + 1 :]])
        at = marked.find(mark, start)
        if at < 0 or marked[:at] != whole[:at] or not whole.endswith(marked[at + 1 :]) or len(marked) - 1 > len(whole):
            return None
        spots.add((at, len(whole) - (len(marked) - at - 1)))
    return spots.pop() if len(spots) == 1 else None


def locate(turns: list[Turn], renderer: Renderer = render) -> Formatted:
    """Render the prefixes of ``turns`` one after the other and find each turn's span and the span of its text. The text of a turn
    that a template changes or leaves out, so that marks don't show its place, has an empty span at its turn's start."""
    before, spans, bodies, two = renderer([]), [], [], marks(turns)
    for k in range(len(turns)):
        now = renderer(turns[: k + 1])
        if not now.startswith(before):
            break
        spans.append((len(before), len(now)))
        bodies.append(_place(turns[: k + 1], k, now, renderer, two, len(before)) or (len(before), len(before)))
        before = now
    else:
        return Formatted(before, spans, bodies, False)
    whole = renderer(turns)
    bodies = [_place(turns, k, whole, renderer, two) or (0, 0) for k in range(len(turns))]
    return Formatted(whole, bodies, bodies, True)


def read_back(text: str) -> list[Turn]:
    """The turns of a text that the built-in template wrote."""
    return [(unescape(r), unescape(t)) for r, t in re.findall(r"<\|turn:(.*?)\|>\n(.*?)<\|end\|>\n", text, re.DOTALL)]


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, formatted string, mask_starts array<long>, mask_stops array<long>"


def formatted(conversations: DataFrame, renderer: Renderer = render, learn: tuple[str, ...] = ("assistant",), texts: bool = True) -> DataFrame:
    """A row per conversation: the formatted text (null if not ``texts``), the spans under the loss mask, digests read back.

    The rows are sorted within hash partitions of conv_id and streamed, so a task holds one conversation at a time. A
    conversation is one text, made whole in one task.
    """
    spark = conversations.sparkSession
    shared.bounded_batches(spark)
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    rows = rows.repartition(shared.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
    own = renderer is render

    def one(conv_id: int | None, turns: list[Turn]) -> dict:
        f = locate(turns, renderer)
        back = read_back(f.text) if own else [(r, unescape(f.text[a:b])) for (r, _), (a, b) in zip(turns, f.bodies)]
        sha = hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in back]).encode("utf-8", "surrogatepass")).hexdigest()
        mask = [body for (role, _), body in zip(turns, f.bodies) if role in learn]
        loss = "".join([unescape(f.text[a:b]) for a, b in mask])
        return {"conv_id": conv_id, "n_turns": len(back), "turns_sha256": sha, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), "formatted_chars": len(f.text), "rewrites": f.rewrites, "formatted": f.text if texts else None, "mask_starts": [a for a, _ in mask], "mask_stops": [b for _, b in mask]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns = None, []
        for batch in batches:
            out = []
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if turns and conv_id != key:
                    out.append(one(key, turns))
                    turns = []
                key = conv_id
                turns.append((role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if turns:
            yield pa.RecordBatch.from_pylist([one(key, turns)], kinds)

    return rows.mapInArrow(run, SCHEMA)
