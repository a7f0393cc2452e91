"""Globs and script-style regular expressions as Java regular expressions."""

from __future__ import annotations

import re

WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SPACE = r"\t\n\x0B\f\r    -     　﻿"


def glob_regex(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` within a name, ``?`` one character; all else as it is."""
    glob = glob.removeprefix("./")
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    to = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(to.get(p, literal_regex(p)) for p in parts) + r"\z"


def literal_regex(text: str) -> str:
    return re.sub(r"[\\^$.*+?()\[\]{}|/-]", lambda m: "\\" + m[0], text)


def may_be_empty(source: str) -> bool:
    """Whether the pattern could match without taking a character: by its least width, and if that can't be told."""
    try:
        return re._parser.parse(source.replace("[^]", r"[\s\S]").replace("[]", "(?!)")).getwidth()[0] == 0
    except (re.error, OverflowError, RecursionError):
        return True


def python_regex(source: str, flags: str = "") -> str:
    """The same pattern for Python's engine."""
    out = re.sub(r"(\\*)\\([wWz])", lambda m: m[0] if len(m[1]) % 2 else m[1] + {"w": "[A-Za-z0-9_]", "W": "[^A-Za-z0-9_]", "z": r"\Z"}[m[2]], java_regex(source, flags, in_class_words=True))
    return out.replace("(?iu", "(?i", 1) if out.startswith("(?iu") else out


def java_regex(source: str, flags: str = "", in_class_words: bool = False) -> str:
    """A pattern that matches in Java what ``source`` matches in a script engine without its unicode mode: ASCII word edges,
    wide white space, an end anchor that ignores a last line end, case folding beyond ASCII."""
    if set(flags) - set("gimsu"):
        raise ValueError(f"unknown regex flags: {flags}")
    out, i, in_class = [], 0, False
    while i < len(source):
        c = source[i]
        pair = source[i : i + 2]
        if c == "\\":
            if pair == r"\b" and not in_class:
                out.append(WORD_EDGE)
            elif pair == r"\s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{SPACE}]")
            elif pair == r"\w" and in_class and in_class_words:
                out.append("A-Za-z0-9_")
            elif pair == r"\d":
                out.append("0-9" if in_class else "[0-9]")
            else:
                out.append(pair)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append("\\[" if c == "[" else "\\&" if pair == "&&" else c)
        elif source.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 2
        elif source.startswith("[]", i):
            out.append("(?!)")
            i += 1
        elif c == "[":
            in_class = True
            out.append(c)
            if source[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "$" and "m" not in flags:
            out.append(r"\z")
        elif c == "." and "s" not in flags:
            out.append(r"[^\n\r  ]")
        else:
            out.append(c)
        i += 1
    marks = ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ("s" if "s" in flags else "")
    return (f"(?{marks})" if marks else "") + "".join(out)


def python_rules() -> list[tuple[re.Pattern, str]]:
    """The redaction rules for Python's engine."""
    from siftwell.operators.redaction import RULES

    plain = lambda p: p.replace(r"\s", "[ \\t\\n\\x0b\\f\\r]").replace(r"[^[ \t\n\x0b\f\r],;]", r"[^ \t\n\x0b\f\r,;]").replace(r"[-\w", "[-A-Za-z0-9_")
    return [(re.compile(plain(p)), re.sub(r"\$(\d)", r"\\g<\1>", to)) for p, to, _, _ in RULES]
