"""Search patterns: from the search dialect to the regular expressions Spark runs.

Patterns are leftmost-first, Unicode by default with simple case folding, and linear unless they ask
for what only backtracking can do.  Spark runs Java expressions, so a pattern is translated once on
the driver: word assertions, POSIX classes, named groups and class algebra become Java's, and options
become inline flags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character in Java, the Unicode reading of \w.
WORD = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}]"
#: The same for ASCII patterns.
ASCII_WORD = "[0-9A-Za-z_]"

#: Word assertions of the dialect, with {w} for a word character.
ASSERTIONS = {
    r"\<": r"(?<!{w})(?={w})",
    r"\>": r"(?<={w})(?!{w})",
    r"\b{start}": r"(?<!{w})(?={w})",
    r"\b{end}": r"(?<={w})(?!{w})",
    r"\b{start-half}": r"(?<!{w})",
    r"\b{end-half}": r"(?!{w})",
}
#: POSIX classes.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"[0-9]", "graph": r"\p{Graph}",
    "lower": r"[a-z]", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"[\t-\r ]", "upper": r"[A-Z]", "word": "[0-9A-Za-z_]", "xdigit": r"[0-9A-Fa-f]",
}


class PatternError(ValueError):
    """A pattern that can't be read, or needs an engine that wasn't allowed."""


@dataclass(frozen=True)
class Pattern:
    """A pattern and how it is to be read."""

    text: str
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    whole_line: bool = False
    unicode: bool = True
    multiline: bool = False
    dotall: bool = False
    verbose: bool = False
    backtracking: bool = False

    @property
    def folds(self) -> bool:
        """Smart case folds unless the pattern's text has an uppercase letter, \\S and \\W included."""
        return self.ignore_case or (self.smart_case and not any(c.isupper() for c in self.text))

    def body(self) -> str:
        """The Java expression without options."""
        if self.fixed:
            return quote(self.text)
        if not self.backtracking and needs_backtracking(self.text):
            raise PatternError(f"only backtracking can run {self.text!r}; allow it with backtracking=True")
        return translate(self.text, self.unicode)

    def flags(self) -> str:
        on = ("iu" if self.unicode else "i") if self.folds else ""
        on += "U" if self.unicode and not self.fixed and re.search(r"\\[wWdDsSbB]", self.text) else ""
        on += "m" * self.multiline + "s" * self.dotall + "x" * (self.verbose and not self.fixed)
        return f"(?{on})" if on else ""

    def java(self) -> str:
        out = self.body()
        if self.whole_line:
            out = f"^(?:{out})$"
        elif self.word:
            w = WORD if self.unicode else ASCII_WORD
            out = f"(?<!{w})(?:{out})(?!{w})"
        return self.flags() + out

    def matches(self, column: Column) -> Column:
        """Whether the pattern is found; plain substrings don't start a regex engine."""
        if self.fixed and not self.folds and not self.word and not self.whole_line:
            return F.contains(column, F.lit(self.text))
        if self.fixed and not self.folds and self.whole_line:
            return column == F.lit(self.text)
        return F.rlike(column, F.lit(self.java()))

    def with_options(self, **options) -> Pattern:
        return replace(self, **options)


def either(patterns: list[Pattern]) -> str:
    """One Java expression that finds any of the patterns, leftmost first and the earlier one first."""
    return "|".join(f"(?:{p.java()})" for p in patterns)


def quote(text: str) -> str:
    """Text as an expression that matches it."""
    return re.sub(r"([\\.^$|?*+()\[\]{}&~\-#\s])", lambda m: {"\n": r"\n", "\t": r"\t", "\r": r"\r", "\f": r"\f", "\v": r"\x0B"}.get(m[1], "\\" + m[1]), text)


def needs_backtracking(pattern: str) -> bool:
    """Lookaround, back references, atomic groups, possessive repeats and conditionals."""
    plain = re.sub(r"\\[^0-9kg]|\[\^?\]?[^\]]*\]", "", pattern)
    return bool(re.search(r"\(\?(?:[=!>(|]|<[=!]|P=|P>|&|R|[0-9])|\\[1-9]|\\[kg][<{'0-9]|(?:[*+?]|\{\d+,?\d*\})\+", plain))


def translate(pattern: str, unicode: bool = True) -> str:
    """The dialect's spellings as Java's; everything both share is kept."""
    out, i = [], 0
    w = WORD if unicode else ASCII_WORD
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            known = next((a for a in sorted(ASSERTIONS, key=len, reverse=True) if pattern.startswith(a, i)), None)
            if known:
                out.append(ASSERTIONS[known].replace("{w}", w))
                i += len(known)
                continue
            if i + 1 == len(pattern):
                raise PatternError("pattern ends in a backslash")
            if pattern[i + 1] in "xu" and pattern.startswith("{", i + 2):
                end = pattern.index("}", i)
                out.append(f"\\x{{{pattern[i + 3 : end]}}}")
                i = end + 1
                continue
            out.append(pattern[i : i + 2])
            i += 2
        elif c == "[":
            text, i = _bracket(pattern, i)
            out.append(text)
        elif pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            out.append(f"(?<{_group_name(pattern[i + 4 : end])}>")
            i = end + 1
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{_group_name(pattern[i + 4 : end])}>")
            i = end + 1
        elif pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in ("=", "!"):
            end = pattern.index(">", i)
            out.append(f"(?<{_group_name(pattern[i + 3 : end])}>")
            i = end + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _group_name(name: str) -> str:
    """Java names are letters and digits only."""
    return re.sub(r"[^A-Za-z0-9]", lambda m: f"x{ord(m[0]):x}", name)


def _bracket(pattern: str, i: int) -> tuple[str, int]:
    """A bracket expression with POSIX classes, nesting and the operators &&, -- and ~~.

    && binds tighter than -- and ~~, which are applied from the left."""
    start = i
    i += 1
    negated = pattern.startswith("^", i)
    i += negated
    terms: list[tuple[str, list[str]]] = [("", [])]  # operator before, items
    first = True
    while True:
        if i >= len(pattern):
            raise PatternError(f"unclosed bracket at {start} of {pattern!r}")
        c = pattern[i]
        if c == "]" and not first:
            i += 1
            break
        if pattern[i : i + 2] in ("&&", "--", "~~") and not first:
            terms.append((pattern[i : i + 2], []))
            i += 2
        elif pattern.startswith("[:", i) and ":]" in pattern[i:]:
            end = pattern.index(":]", i)
            name = pattern[i + 2 : end]
            if name.lstrip("^") not in POSIX:
                raise PatternError(f"unknown class [:{name}:]")
            terms[-1][1].append(f"[^{POSIX[name[1:]]}]" if name.startswith("^") else POSIX[name])
            i = end + 2
        elif c == "[":
            text, i = _bracket(pattern, i)
            terms[-1][1].append(text)
        elif c == "\\":
            terms[-1][1].append(pattern[i : i + 2])
            i += 2
        else:
            terms[-1][1].append("\\" + c if c in "&~^" or (c in "-]" and first) else c)
            i += 1
        first = False

    def joined(items: list[str]) -> str:
        return f"[{''.join(items)}]" if items else r"[^\x{0}-\x{10FFFF}]"

    # && first
    groups: list[tuple[str, str]] = []
    for op, items in terms:
        text = joined(items)
        if op == "&&":
            before, left = groups[-1]
            groups[-1] = (before, f"[{left}&&{text}]")
        else:
            groups.append((op, text))
    value = groups[0][1]
    for op, text in groups[1:]:
        if op == "--":
            value = f"[{value}&&[^{text}]]"
        else:
            value = f"[[{value}&&[^{text}]][{text}&&[^{value}]]]"
    if negated:
        value = f"[^{value[1:-1]}]" if len(groups) == 1 and len(terms) == 1 and "&&" not in value else f"[^{value}]"
    return value, i


def replacement(template: str, names: tuple[str, ...] = ()) -> str:
    """A template with $1, ${1}, $name, ${name}, $0 and $$ as Java's; unknown groups are empty, a lone $ is itself.

    names are the pattern's group names in order, empty for unnamed groups."""
    out, i = [], 0
    while i < len(template):
        if template[i] != "$":
            out.append("\\\\" if template[i] == "\\" else template[i])
            i += 1
            continue
        if template.startswith("$$", i):
            out.append("\\$")
            i += 2
            continue
        m = re.compile(r"\$(?:\{(\w+)\}|(\w+))").match(template, i)
        if not m:
            out.append("\\$")
            i += 1
            continue
        name = m[1] or m[2]
        number = int(name) if name.isdigit() else names.index(name) + 1 if name in names else None
        if number is not None and number <= len(names):
            out.append(f"${number}" + ("" if not re.match(r"\d", template[m.end() :]) else ""))
        i = m.end()
    return "".join(out)


def group_names(pattern: str) -> tuple[str, ...]:
    """Names of the pattern's groups in order, empty for those without."""
    plain = re.sub(r"\\.|\[\^?\]?[^\]]*\]", "..", pattern)
    return tuple(m[1] or "" for m in re.finditer(r"\((?:\?P?<([A-Za-z_]\w*)>|(?!\?))", plain))
