"""The regular-expression functions of a host language as columns: search, match, fullmatch, findall, split, sub.

What the JVM has is used as it is; spans, windows, callbacks and counts of replacements run as Arrow functions over
whole batches, with the pattern compiled once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import Pattern, quote, replacement

MATCH = "struct<start:long,end:long,match:string,groups:array<string>>"


def search(text: Column, pattern: Pattern) -> Column:
    """The first match, null if there is none."""
    return F.when(F.rlike(text, F.lit(pattern.java())), F.regexp_extract(text, pattern.java(), 0))


def match(text: Column, pattern: Pattern) -> Column:
    """The match at the text's start."""
    java = rf"\A(?:{pattern.java()})"
    return F.when(F.rlike(text, F.lit(java)), F.regexp_extract(text, java, 0))


def fullmatch(text: Column, pattern: Pattern) -> Column:
    """Whether the whole text matches."""
    return F.rlike(text, F.lit(rf"\A(?:{pattern.java()})\z"))


def findall(text: Column, pattern: Pattern, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern.java()})"), F.lit(group + 1 if group else 1))


def count(text: Column, pattern: Pattern) -> Column:
    return F.regexp_count(text, F.lit(pattern.java())).cast("long")


def split(text: Column, pattern: Pattern, most: int = 0) -> Column:
    """One piece more than there are matches; with `most` at most that many cuts."""
    return F.split(text, pattern.java(), most + 1 if most else -1)


def sub(text: Column, pattern: Pattern, template: str, names: tuple[str, ...] = ()) -> Column:
    return F.regexp_replace(text, F.lit(pattern.java()), F.lit(replacement(template, names)))


def sub_first(text: Column, pattern: Pattern, literal: str) -> Column:
    """The first match replaced by a text as it is."""
    at = F.regexp_instr(text, F.lit(pattern.java()))
    found = F.regexp_extract(text, pattern.java(), 0)
    return F.when(at > 0, F.concat(F.left(text, at - 1), F.lit(literal), F.substring(text, at + F.length(found), F.lit(1 << 30)))).otherwise(text)


def escape(text: str) -> str:
    return quote(text)


def finditer(pattern: str, *, start: int = 0, stop: int | None = None, anchored: bool = False, flags: int = 0) -> Callable[[Column], Column]:
    """All matches with spans in characters and groups, in a window that does not move what anchors and look-behind see."""

    @F.pandas_udf(f"array<{MATCH}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        compiled = regex.compile(pattern, flags)

        def of(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            end = len(text) if stop is None else min(stop, len(text))
            found = [m] if anchored and (m := compiled.match(text, start, end)) else [] if anchored else compiled.finditer(text, start, end)
            return [{"start": x.start(), "end": x.end(), "match": x[0], "groups": list(x.groups())} for x in found]

        for column in batches:
            yield column.map(of)

    return run


def sub_with(pattern: str, function: Callable[[object], str], most: int = 0) -> Callable[[Column], Column]:
    """Matches replaced by what a function of the match returns; also tells how many were: struct (text, n)."""

    @F.pandas_udf("struct<text:string,n:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        compiled = regex.compile(pattern)
        for column in batches:
            rows = [(None, 0) if t is None else compiled.subn(function, t, count=most) for t in column]
            yield pd.DataFrame(rows, columns=["text", "n"])

    return run


def fold_orbit(char: str) -> list[str]:
    """Characters that simple case folding holds to be equal to one, itself included."""
    folded = _simple_fold(char)
    near = {x for c in (char, folded) for x in (c, c.lower(), c.upper(), c.title())} | {c for c in map(chr, _FOLDED) if _simple_fold(c) == folded}
    return sorted(c for c in near if len(c) == 1 and _simple_fold(c) == folded)


#: Characters that fold to another without being its upper or lower case.
_FOLDED = (0x00B5, 0x017F, 0x0345, 0x03C2, 0x03D0, 0x03D1, 0x03D5, 0x03D6, 0x03F0, 0x03F1, 0x03F5, 0x1E9B, 0x1FBE, 0x2126, 0x212A, 0x212B)


def _simple_fold(char: str) -> str:
    folded = char.casefold()
    return folded if len(folded) == 1 else char.lower() if len(char.lower()) == 1 else char


def property_ranges(name: str) -> list[tuple[int, int]]:
    """Code point ranges, inclusive, of a general category or script-like property, as the regex library knows it."""
    import regex

    runs = regex.compile(rf"\p{{{name}}}+")
    out: list[tuple[int, int]] = []
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):  # no text has a surrogate by itself
        every = "".join(map(chr, range(low, high)))
        out += [(low + m.start(), low + m.end() - 1) for m in runs.finditer(every)]
    return out


def property_counts(names: list[str]) -> Callable[[Column], Column]:
    """How many characters of a text have each property, null for a null text: a table by code point is read once a character."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = np.zeros(0x110000, np.uint64)
        for k, name in enumerate(names):
            for low, high in property_ranges(name):
                marks[low : high + 1] |= np.uint64(1 << k)

        def of(text: str | None) -> list[int] | None:
            if text is None:
                return None
            found = marks[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            return [int(np.count_nonzero(found & np.uint64(1 << k))) for k in range(len(names))]

        for column in batches:
            yield column.map(of)

    if len(names) > 64:
        raise ValueError("at most 64 properties")
    return run
