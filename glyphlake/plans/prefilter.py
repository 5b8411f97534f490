"""What any match of a pattern must contain, read from its syntax tree: the plan that narrows a search.

The tree is that of the search dialect; where it isn't certain nothing is required.  The facts are necessary conditions only.  They give and-or-and plans of trigrams for the index, class runs for the run
columns, and plain substrings that Spark tests before it starts a regular expression.  An index may narrow, the
pattern decides; with the plan off the answer is the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import syntax
from ..functions.patterns import Pattern, needs_backtracking
from ..operators import indexes

#: Literals of an exact set, and their length, beyond which it is cut to what is still required.
MOST_LITERALS, MOST_LENGTH = 64, 64
#: Characters of a class that are spelled out.
MOST_CHARACTERS = 4


@dataclass
class Facts:
    """exact: all texts that match, if few; required: for each entry one of its texts must stand in a match."""

    exact: frozenset[str] | None = None
    required: list[frozenset[str]] = field(default_factory=list)
    prefixes: frozenset[str] | None = None
    suffixes: frozenset[str] | None = None
    least: int = 0
    most: int | None = 0
    anchored_start: bool = False
    anchored_end: bool = False

    @property
    def nullable(self) -> bool:
        return self.least == 0

    def clauses(self) -> list[frozenset[str]]:
        """The and-or plan of substrings."""
        own = [self.exact] if self.exact and all(self.exact) else []
        return _simplified(own + self.required)


def _simplified(clauses: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without clauses that another one implies."""
    out: list[frozenset[str]] = []
    for c in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(all(any(x in y for x in c) for y in k) for k in out):
            out.append(c)
    return out


def _product(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    if len(a) * len(b) > MOST_LITERALS:
        return None
    out = frozenset(x + y for x in a for y in b)
    return out if max(map(len, out), default=0) <= MOST_LENGTH else None


def _any() -> Facts:
    return Facts(None, [], None, None, 1, 1)


def facts(pattern: str, ignore_case: bool = False, unicode: bool = True) -> Facts:
    """Facts of a pattern; of one that isn't read with certainty, nothing is required."""
    try:
        if needs_backtracking(pattern):
            raise syntax.Unclear("backtracking")
        found = _facts(syntax.read(pattern, unicode))
    except (syntax.Unclear, RecursionError):
        return Facts(None, [], None, None, 0, None)
    if ignore_case:
        return Facts(None, [], None, None, found.least, found.most)
    # a line's start is the text's only without flags
    if "(?" in pattern:
        found.anchored_start = found.anchored_end = False
    return found


def _sequence(parts: tuple) -> Facts:
    out = Facts(frozenset([""]))
    pending: frozenset[str] | None = frozenset([""])  # exact texts since the last gap
    for node in parts:
        if isinstance(node, syntax.Anchor):
            out.anchored_start |= node.kind == "start" and out.most == 0
            out.anchored_end |= node.kind == "end"
            continue
        out.anchored_end = False
        part = _facts(node)
        out.least += part.least
        out.most = None if out.most is None or part.most is None else out.most + part.most
        joined = _product(pending, part.exact) if pending is not None and part.exact is not None else None
        if joined is not None:
            pending = joined
            out.exact = _product(out.exact, part.exact) if out.exact is not None else None
            continue
        if pending and all(pending):
            out.required.append(pending)
        out.exact = None
        out.required += part.required
        pending = part.exact if part.exact is not None else frozenset([""])
        if part.exact is not None and all(part.exact):
            out.required.append(part.exact)
    if out.exact is None and pending and all(pending):
        out.required.append(pending)
    if out.exact is not None:
        out.prefixes = out.suffixes = out.exact
    out.required = _simplified(out.required)
    return out


def _facts(node) -> Facts:
    if isinstance(node, syntax.Char):
        if node.of is not None and 0 < syntax.size(node.of) <= MOST_CHARACTERS:
            return Facts(frozenset(chr(c) for a, b in node.of for c in range(a, b + 1)), [], None, None, 1, 1)
        return _any()
    if isinstance(node, syntax.Sequence):
        return _sequence(node.parts)
    if isinstance(node, syntax.Anchor):
        return _sequence((node,))
    if isinstance(node, syntax.Choice):
        parts = [_facts(b) for b in node.parts]
        exact = frozenset().union(*[p.exact for p in parts]) if all(p.exact is not None for p in parts) else None
        if exact is not None and len(exact) > MOST_LITERALS:
            exact = None
        required = []
        if exact is None and all(p.clauses() for p in parts):
            # one clause of each branch: the one with the longest texts
            chosen = [max(p.clauses(), key=lambda c: (min(map(len, c)), -len(c))) for p in parts]
            merged = frozenset().union(*chosen)
            required = [merged] if len(merged) <= MOST_LITERALS else []
        most = None if any(p.most is None for p in parts) else max(p.most for p in parts)
        return Facts(exact, required, None, None, min(p.least for p in parts), most)
    part = _facts(node.part)
    most = None if node.high is None or part.most is None else part.most * node.high
    if node.low == 0:
        return Facts(None, [], None, None, 0, most)
    exact: frozenset[str] | None = frozenset([""])
    for _ in range(min(node.low, MOST_LENGTH)):
        exact = _product(exact, part.exact) if exact is not None and part.exact is not None else None
    whole = node.low == node.high and node.low <= MOST_LENGTH
    required = list(part.required)
    if exact is not None and not whole and all(exact):
        required.append(exact)
    elif exact is None and part.exact and all(part.exact):
        required.append(part.exact)
    return Facts(exact if whole else None, required, None, None, part.least * node.low, most)


def trigram_plan(found: Facts) -> list[list[list[str]]]:
    """Clauses of terms of trigrams: in each clause one term must have all its trigrams.  Empty: nothing is narrowed."""
    clauses = []
    for clause in found.clauses():
        terms = [indexes.literal_trigrams(x) for x in sorted(clause)]
        if all(terms):
            clauses.append(terms)
    return clauses


def guard(column: Column, found: Facts) -> Column:
    """The plan as plain substring tests."""
    out = F.lit(True)
    for clause in found.clauses():
        some = F.lit(False)
        for x in sorted(clause):
            some = some | F.contains(column, F.lit(x))
        out = out & some
    return out


def search(docs: DataFrame, pattern: Pattern, *, postings: DataFrame | None = None, runs: bool = False, planned: bool = True) -> DataFrame:
    """Documents in which the pattern is found; index, runs and guard only spare work."""
    kept = docs
    if planned and not pattern.folds and not pattern.verbose:
        found = Facts(frozenset([pattern.text]), [], None, None, len(pattern.text), len(pattern.text)) if pattern.fixed else facts(pattern.text, unicode=pattern.unicode)
        plan = trigram_plan(found)
        if postings is not None and plan:
            kept = kept.join(indexes.candidates_cnf(postings, plan), "doc_id", "left_semi")
        if runs and not pattern.fixed:
            kept = kept.where(indexes.survives(indexes.required_runs(pattern.text, pattern.unicode)))
        kept = kept.where(guard(F.col("text"), found))
    return kept.where(pattern.matches(F.col("text")))
