"""Lexers and span masks, where text has to be read from left to right.

These run as Arrow functions and table functions over whole documents; the rules are compiled once a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rowwise import exploded

CODE, COMMENT, LITERAL = 0, 1, 2


@dataclass(frozen=True)
class Rules:
    """Token rules: at a place the longest match wins; all rules tied at that length are its winners, ascending."""

    patterns: tuple[str, ...]

    def compiled(self) -> list:
        import regex

        return [regex.compile(p, regex.POSIX) for p in self.patterns]  # the longest match, not the first alternative


def longest_at(compiled: list, text: str, at: int, allowed: frozenset[int] | None = None) -> tuple[int, list[int]] | None:
    """End and winners of the longest match that starts exactly at a place; None if no allowed rule matches there."""
    best, winners = -1, []
    for i, rule in enumerate(compiled):
        if allowed is not None and i not in allowed:
            continue
        found = rule.match(text, at)
        if not found:
            continue
        end = found.end()
        if end > best:
            best, winners = end, [i]
        elif end == best:
            winners.append(i)
    return (best, winners) if winners else None


def shortest_at(compiled: list, text: str, at: int) -> tuple[int, list[int]] | None:
    """End and winners of the shortest match of at least one character."""
    for stop in range(at + 1, len(text) + 1):
        winners = [i for i, rule in enumerate(compiled) if rule.fullmatch(text, at, stop)]
        if winners:
            return stop, winners
    return None


def scanner(rules: Rules) -> Callable[[str], Iterator[tuple[int, int, int]]]:
    """scan() for a set of rules: where no rule has groups of its own, one expression tries them all at a place."""
    import regex

    compiled = rules.compiled()
    if any(rule.groups or "(?" in rule.pattern for rule in compiled):  # numbers, names or flags that would reach other rules
        return lambda text: scan(compiled, text)
    # the longest alternative matches, and of equal ones the first
    every = regex.compile("|".join(f"({rule.pattern})" for rule in compiled), regex.POSIX)

    def of(text: str) -> Iterator[tuple[int, int, int]]:
        at = 0
        for m in every.finditer(text):
            start, end = m.span()
            if start < end:
                for k in range(at, start):
                    yield k, k + 1, -1
                yield start, end, m.lastindex - 1
                at = end
        for k in range(at, len(text)):
            yield k, k + 1, -1

    return of


def scan(compiled: list, text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, rule) from left to right; a place where no rule matches is skipped by one character as rule -1."""
    at = 0
    while at < len(text):
        found = longest_at(compiled, text, at)
        if found is None or found[0] == at:
            yield at, at + 1, -1
            at += 1
        else:
            yield at, found[0], found[1][0]
            at = found[0]


def tokens(df: DataFrame, rules: Rules, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spelled: bool = True) -> DataFrame:
    """(keep..., start, end, rule[, token]): a text's tokens by the longest match, ties to the earlier rule."""

    def made() -> Callable[[str | None], Iterator[tuple]]:
        of = scanner(rules)
        return (lambda t: ((a, b, r, t[a:b]) for a, b, r in of(t or ""))) if spelled else lambda t: of(t or "")

    return exploded(df, keep, text, "start long, end long, rule long" + ", token string" * spelled, made)


def actions(df: DataFrame, rules: dict[str, str | None], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., ordinal, rule, value): the tokens of each text that stand in a row from its start, under their rules' SQL
    expressions over `token` (None drops a token); a last row with rule -1 holds the rest that no rule matched."""
    found = tokens(df, Rules(tuple(rules)), text, keep)
    first_gap = F.min(F.when(F.col("rule") == -1, F.col("start"))).over(Window.partitionBy(*keep))
    rows = found.withColumn("gap", first_gap)
    value = F.lit(None).cast("string")
    for k, made in enumerate(rules.values()):
        value = F.when(F.col("rule") == k, F.expr(made).cast("string") if made is not None else F.lit(None)).otherwise(value)
    kept = F.array(*[F.lit(k) for k, made in enumerate(rules.values()) if made is not None]).cast("array<bigint>")
    done = rows.where(F.col("gap").isNull() | (F.col("start") < F.col("gap"))).where(F.array_contains(kept, F.col("rule"))).select(*keep, F.col("start").alias("ordinal"), "rule", value.alias("value"))
    rest = rows.where(F.col("start") >= F.col("gap")).groupBy(*keep).agg(F.min("gap").alias("ordinal"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "token"))), lambda x: x["token"]), "").alias("value"))
    return done.unionByName(rest.select(*keep, "ordinal", F.lit(-1).cast("long").alias("rule"), "value"))


@dataclass(frozen=True)
class Comments:
    """Comment and string syntax of a family of languages."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")


FAMILIES = {"c": Comments(), "hash": Comments(("#",), (), ('"', "'")), "sql": Comments(("--",), (("/*", "*/"),), ("'",)), "markup": Comments((), (("<!--", "-->"),), ('"',))}


@cache
def _marked(syntax: Comments) -> re.Pattern:
    """Comments (group 1) and string literals (group 2), each up to its end or the text's; a literal also ends with its line."""
    comments = [re.escape(x) + r"[^\n]*" for x in syntax.line] + [f"{re.escape(a)}(?s:.*?)(?:{re.escape(b)}|\\Z)" for a, b in syntax.block]
    literals = [rf"{q}(?:\\(?s:.|\Z)|[^\\\n{q}])*+{q}?" for q in map(re.escape, syntax.quotes)]
    return re.compile(f"({'|'.join(comments) or '(?!)'})|({'|'.join(literals) or '(?!)'})")


def span_kinds(text: str, syntax: Comments) -> list[tuple[int, int, int]]:
    """(start, end, kind) runs of code, comments and string literals."""
    out, start = [], 0
    for m in _marked(syntax).finditer(text):
        if m.start() > start:
            out.append((start, m.start(), CODE))
        out.append((m.start(), m.end(), COMMENT if m.lastindex == 1 else LITERAL))
        start = m.end()
    if len(text) > start:
        out.append((start, len(text), CODE))
    return out


def scoped_matches(df: DataFrame, pattern: str, kinds: tuple[int, ...], syntax: Comments = FAMILIES["c"], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., start, end, match): matches that start in a span of one of the kinds."""

    def made() -> Callable[[str | None], Iterator[tuple]]:
        import bisect

        import regex

        compiled = regex.compile(pattern)

        def of(value: str | None) -> Iterator[tuple]:
            spans = span_kinds(value or "", syntax)
            starts = [s for s, _, _ in spans]
            for m in compiled.finditer(value or ""):
                if spans and spans[max(0, bisect.bisect_right(starts, m.start()) - 1)][2] in kinds:
                    yield m.start(), m.end(), m[0]

        return of

    return exploded(df, keep, text, "start long, end long, match string", made)


def comment_only(line: Column) -> Column:
    return F.rlike(line, F.lit(r"\A\s*(?://|#|/\*|\*|\\\\)"))


def spans(df: DataFrame, pattern: str, text: str = "line", keep: tuple[str, ...] = ("doc_id", "line_number"), start: int = 0, stop: int | None = None, flags: int = 0) -> DataFrame:
    """(keep..., start, end, match) in UTF-8 bytes of all matches, empty ones included, in a window that does not move what anchors see."""

    def made() -> Callable[[str | None], Iterator[tuple]]:
        import regex

        compiled = regex.compile(pattern, flags)

        def of(value: str | None) -> Iterator[tuple]:
            place, size = 0, 0
            for m in compiled.finditer(value, start, len(value) if stop is None else stop) if value is not None else ():
                # bytes up to the match are those up to the last one and between
                size += len(value[place : m.start()].encode())
                place, end = m.end(), size + len(m[0].encode())
                yield size, end, m[0]
                size = end

        return of

    return exploded(df, keep, text, "start long, end long, match string", made)


def nearest_name(name: str, known: list[str]) -> str | None:
    """The known name within max(1, length / 4) edits (insert, delete, replace, swap of neighbours); none if two are equally near."""
    budget = max(1, len(name) // 4)
    scored = sorted((edit_distance(name, k), k) for k in known)
    near = [s for s in scored if s[0] <= budget]
    return near[0][1] if near and (len(near) == 1 or near[0][0] < near[1][0]) else None


def nearest_names(name: Column, known: list[str]) -> Column:
    """Of each name the known one that nearest_name finds; the known names are a constant of the plan."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            found = {n: nearest_name(n, known) for n in column.dropna().unique()}
            yield column.map(lambda n: found.get(n))

    return run(name)


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]
