"""Many patterns at once: attribution of hits to patterns, needles, and plans over attributed rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.paths import glob_applies
from ..functions.patterns import Pattern, either
from ..functions.rowwise import exploded
from .search import any_line


@dataclass(frozen=True)
class PatternSet:
    """Named patterns; each answers as if it ran alone.  One projection tests them all in one scan."""

    patterns: dict[str, Pattern]

    def labels(self) -> list[str]:
        return list(self.patterns)

    def label_column(self, pattern: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.labels()]), pattern.cast("int") + 1)

    def which(self, column: Column) -> Column:
        """Numbers of the patterns found, ascending."""
        return F.array_compact(F.array(*[F.when(p.matches(column), F.lit(i).cast("long")) for i, p in enumerate(self.patterns.values())]))

    def document_mask(self, corpus: Corpus) -> DataFrame:
        """(doc_id, path, patterns): the patterns that some line of a document matches."""
        found = F.array_compact(F.array(*[F.when(any_line(F.col("text"), p), F.lit(i).cast("long")) for i, p in enumerate(self.patterns.values())]))
        return corpus.df.select("doc_id", "path", found.alias("patterns")).where(F.size("patterns") > 0)

    def line_hits(self, corpus: Corpus) -> DataFrame:
        """(path, line, pattern_id), one row for a pattern on a line."""
        # inside a document first: only lines with some pattern become rows
        parts = F.split(F.col("text"), "\n", -1)
        kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        hits = F.filter(F.transform(kept, lambda line, at: F.struct((at + 1).cast("long").alias("line"), self.which(line).alias("found"))), lambda x: F.size(x["found"]) > 0)
        rows = corpus.df.where(F.rlike("text", F.lit(self.anywhere()))) if self.guarded() else corpus.df
        return rows.select("path", F.inline(hits)).select("path", "line", F.explode("found").alias("pattern_id"))

    def guarded(self) -> bool:
        """Whether one expression over a whole document tells that no line can match: lines' ends must not matter."""
        return not any(p.whole_line or p.multiline or (not p.fixed and re.search(r"[\^$]|\\[AzZ]", p.text)) for p in self.patterns.values())

    def anywhere(self) -> str:
        return either(list(self.patterns.values()))

    def roll_call(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """(keep..., pattern_id) of the patterns found in each text, for large sets: one pass of an automaton over all
        texts that matches must contain names the patterns that are possible, and only these are tried."""
        import ahocorasick

        from ..plans import prefilter

        needed: dict[str, set[int]] = {}
        always = []
        for i, p in enumerate(self.patterns.values()):
            facts = prefilter.facts(p.text, unicode=p.unicode) if not p.fixed else None
            clauses = [frozenset([p.text])] if p.fixed else facts.clauses()
            if p.folds or p.verbose or not clauses:
                always.append(i)
                continue
            for literal in max(clauses, key=lambda c: (min(map(len, c)), -len(c))):
                needed.setdefault(literal, set()).add(i)

        @F.pandas_udf("array<int>")
        def possible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = ahocorasick.Automaton()
            for literal, numbers in needed.items():
                automaton.add_word(literal, numbers)
            automaton.make_automaton()
            for column in batches:
                yield column.map(lambda value: sorted(set(always).union(*(numbers for _, numbers in automaton.iter(value or "")))) if needed else always)

        rows = df.select(*keep, F.col(text).alias("__text"), F.explode(possible(F.col(text))).alias("__i"))
        found = F.lit(False)
        for i, p in enumerate(self.patterns.values()):
            found = F.when(F.col("__i") == i, p.matches(F.col("__text"))).otherwise(found)
        return rows.where(found).select(*keep, F.col("__i").cast("long").alias("pattern_id"))

    def buffer_mask(self, corpus: Corpus) -> DataFrame:
        """As document_mask, with the whole text as one subject, so that matches may cross lines."""
        return corpus.df.select("doc_id", "path", self.which(F.col("text")).alias("patterns")).where(F.size("patterns") > 0)


@dataclass(frozen=True)
class RowPlan:
    """Filter by path glob, group, sort, limit: over rows (path, line, pattern_id)."""

    patterns: PatternSet
    glob: str | None = None
    group: str | None = None  # pattern, file or none
    order: str = "count"  # count (descending, then label) or label
    limit: int = 0  # 0: all

    def run(self, rows: DataFrame) -> DataFrame:
        kept = rows.where(glob_applies(F.col("path"), self.glob)) if self.glob else rows
        if self.group is None:
            out = kept.orderBy("path", "line", "pattern_id")
        else:
            label = self.patterns.label_column(F.col("pattern_id")) if self.group == "pattern" else F.col("path")
            out = kept.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"))
            out = out.orderBy(F.desc("count"), "label") if self.order == "count" else out.orderBy("label")
        return out.limit(self.limit) if self.limit else out


#: Patterns of a table that are sent to the tasks at once; more are tested in several passes.
TABLE_PATTERNS = 5_000


def from_table(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Attribution by a table of patterns (pattern_id, pattern): the documents' columns and the patterns', a row a match.

    For pattern sets that are data; a set known to the driver is a PatternSet.  A block of patterns of bounded number is
    one array of constants of a pass, so that each expression is compiled once and no join by predicate is needed."""
    kind = patterns.schema["pattern_id"].dataType
    rows = patterns.select("pattern_id", "pattern").where(F.col("pattern").isNotNull()).toLocalIterator()
    out = None
    while block := list(islice(rows, TABLE_PATTERNS)):
        found = F.array_compact(F.array(*[F.when(F.rlike(F.col(text), F.lit(p)), F.struct(F.lit(k).cast(kind).alias("pattern_id"), F.lit(p).alias("pattern"))) for k, p in block]))
        part = docs.select("*", F.inline(found))
        out = part if out is None else out.unionByName(part)
    return docs.select("*", F.lit(None).cast(kind).alias("pattern_id"), F.lit(None).cast("string").alias("pattern")).limit(0) if out is None else out


@dataclass(frozen=True)
class Needles:
    """Plain strings with every occurrence, overlapping ones included, ordered by end and needle."""

    needles: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not all(self.needles):
            raise ValueError("an empty needle stands everywhere")

    def which(self, column: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(column, F.lit(x)), F.lit(i).cast("long")) for i, x in enumerate(self.needles)]))

    def occurrences(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """(keep..., needle_id, start, end) in characters from 0."""
        found = [_spans(F.col(text), i, x) for i, x in enumerate(self.needles)]
        # documents without any needle never reach the position search
        some = F.size(self.which(F.col(text))) > 0
        return df.where(some).select(*keep, F.inline(F.flatten(F.array(*found))))


def _spans(text: Column, number: int, needle: str) -> Column:
    return F.transform(positions(text, needle), lambda p: F.struct(F.lit(number).cast("long").alias("needle_id"), p.alias("start"), (p + len(needle)).alias("end")))


def positions(text: Column, needle: str) -> Column:
    """Places of every occurrence, from 0, overlapping ones included: the text is cut before each of them."""
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(text, f"(?={quoted})", -1)
    none = F.array().cast("array<bigint>")
    # each part but the first begins with the needle; so does the first if the text does
    start = F.struct(none.alias("at"), F.lit(0).cast("long").alias("pos"))
    step = lambda acc, part: F.struct(F.concat(acc["at"], F.array(acc["pos"] + F.length(part))).alias("at"), (acc["pos"] + F.length(part)).alias("pos"))
    later = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["at"]
    first = F.when(F.startswith(text, F.lit(needle)), F.array(F.lit(0).cast("long"))).otherwise(none)
    return F.when(F.contains(text, F.lit(needle)), F.concat(first, later)).otherwise(none)


def pattern_ends(df: DataFrame, patterns: dict[str, str], text: str = "line", keep: tuple[str, ...] = ("doc_id", "line_number")) -> DataFrame:
    """(keep..., pattern_id, end): every place where some match of a pattern ends, overlapping matches included.

    Arrow batches; a look-behind reads each pattern backwards from every place, so a text is passed once a pattern."""
    import regex

    compiled = list(patterns.values())
    if len(compiled) > 64:
        raise ValueError("at most 64 patterns")

    def made() -> Callable[[str | None], Iterator[tuple]]:
        lookbehinds = [regex.compile(f"(?<=(?:{p}))") for p in compiled]
        return lambda value: ((i, m.end()) for i, p in enumerate(lookbehinds) for m in p.finditer(value or ""))

    return exploded(df, keep, text, "pattern_id long, end long", made)
