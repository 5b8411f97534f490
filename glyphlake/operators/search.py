"""Line search and its modes.

All modes start from the same lines and predicates; what differs is the aggregation on top.  Counting
modes shuffle one partial row a document; only modes that need neighbouring lines use windows, which
are partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus, split_lines
from ..functions.patterns import Pattern, either, replacement


def by_line():
    return Window.partitionBy("doc_id").orderBy("line_number")


def any_line(text: Column, pattern: Pattern, separator: str = "\n") -> Column:
    """Whether some line of the text matches, without making rows of lines."""
    parts = F.split(text, separator, -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    if pattern.fixed and not (pattern.folds or pattern.word or pattern.whole_line) and separator not in pattern.text and pattern.text:
        return F.contains(text, F.lit(pattern.text))
    return F.exists(kept, lambda line: pattern.matches(line))


def files_with_matches(corpus: Corpus, pattern: Pattern) -> DataFrame:
    return corpus.df.where(any_line(F.col("text"), pattern)).select("path")


def files_without_match(corpus: Corpus, pattern: Pattern) -> DataFrame:
    return corpus.df.where(~F.coalesce(any_line(F.col("text"), pattern), F.lit(False))).select("path")


def exists(corpus: Corpus, pattern: Pattern) -> bool:
    """Stops at the first document that matches."""
    return not files_with_matches(corpus, pattern).isEmpty()


def matching_lines(corpus: Corpus, pattern: Pattern, invert: bool = False) -> DataFrame:
    found = pattern.matches(F.col("line"))
    return corpus.lines().where(~found if invert else found)


def with_position(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """The byte column, from 1, of each line's first match."""
    at = F.regexp_instr("line", F.lit(pattern.java()))
    return lines.withColumn("column", (F.octet_length(F.left("line", at - 1)) + 1).cast("long"))


def count_lines(corpus: Corpus, pattern: Pattern, invert: bool = False, include_zero: bool = False, cap: int | None = None) -> DataFrame:
    """Matching lines of each file: counted inside the document, so nothing is shuffled."""
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    hits = F.size(F.filter(kept, lambda x: ~pattern.matches(x) if invert else pattern.matches(x))).cast("long")
    n = F.greatest(F.coalesce(hits, F.lit(0)), F.lit(0)).cast("long")
    out = corpus.df.select("path", (F.least(n, F.lit(cap).cast("long")) if cap is not None else n).alias("n"))
    return out if include_zero else out.where("n > 0")


def count_matches(corpus: Corpus, pattern: Pattern, include_zero: bool = False) -> DataFrame:
    """Match spans of each file, line by line."""
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(pattern.java())).cast("long"))
    out = corpus.df.select("path", F.coalesce(total, F.lit(0).cast("long")).alias("n"))
    return out if include_zero else out.where("n > 0")


def only_matching(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """One row a span, in order; empty spans are left out."""
    spans = F.regexp_extract_all("line", F.lit(f"({pattern.java()})"), F.lit(1))
    return lines.select("doc_id", "path", "line_number", F.posexplode(F.filter(spans, lambda s: s != "")).alias("at", "match")).select("doc_id", "path", "line_number", (F.col("at") + 1).cast("long").alias("ordinal"), "match")


def cap_per_file(lines: DataFrame, most: int) -> DataFrame:
    """The first `most` lines of each file; 0 takes none."""
    return lines.withColumn("__rank", F.row_number().over(by_line())).where(F.col("__rank") <= most).drop("__rank")


def stop_on_nonmatch(lines: DataFrame, found: Column) -> DataFrame:
    """Of each file the matching lines up to the first that doesn't match behind one that does."""
    running = by_line().rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__hit", found)
    broken = F.max((~F.col("__hit")) & F.col("__any")).over(running)
    return marked.withColumn("__any", F.max("__hit").over(running)).withColumn("__broken", broken).where("__hit and not __broken").drop("__hit", "__any", "__broken")


def with_context(lines: DataFrame, found: Column, before: int, after: int) -> DataFrame:
    """Matches and the lines around them: kind is match or context, band numbers the runs of neighbouring lines."""
    marked = lines.withColumn("__hit", found)
    near = F.max("__hit").over(by_line().rowsBetween(-after, before))
    kept = marked.withColumn("__near", near).where("__near")
    jump = F.coalesce((F.col("line_number") - F.lag("line_number").over(by_line()) > 1).cast("long"), F.lit(0).cast("long"))
    kept = kept.withColumn("__jump", jump)
    band = F.sum("__jump").over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    return kept.select("doc_id", "path", "line_number", "line", F.when(F.col("__hit"), "match").otherwise("context").alias("kind"), (band + 1).alias("band"))


def passthru(lines: DataFrame, found: Column) -> DataFrame:
    return lines.withColumn("is_match", found)


def replace_matches(lines: DataFrame, pattern: Pattern, template: str, names: tuple[str, ...] = ()) -> DataFrame:
    """Matching lines with every match replaced by a template."""
    return lines.where(pattern.matches(F.col("line"))).withColumn("line", F.regexp_replace("line", F.lit(pattern.java()), F.lit(replacement(template, names))))


def trimmed(line: Column, most: int | None = None, preview: bool = False) -> Column:
    """Leading white space off; a line of more than `most` characters is left out or previewed."""
    text = F.regexp_replace(line, r"\A[ \t]+", "")
    if most is None:
        return text
    long = F.length(text) > most
    return F.when(long, F.concat(F.left(text, F.lit(most)), F.lit(" [...]")) if preview else F.lit("[Omitted long matching line]")).otherwise(text)


def snippet(line: Column, pattern: Pattern, width: int = 120) -> Column:
    """At most `width` characters around the first match, with marks where it was cut."""
    text = F.regexp_replace(line, r"\A\s+|\s+\z", "")
    at = F.regexp_instr(text, F.lit(pattern.java()))
    start = F.greatest(F.lit(1), F.least(at - F.lit(width // 4), F.length(text) - (width - 1)))
    cut = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def captures(lines: DataFrame, pattern: Pattern, groups: dict[str, int]) -> DataFrame:
    """The named groups of each line's first match; a group that wasn't entered is empty."""
    hit = lines.where(pattern.matches(F.col("line")))
    return hit.select("doc_id", "path", "line_number", *[F.regexp_extract("line", pattern.java(), k).alias(n) for n, k in groups.items()])


def records(corpus: Corpus, separator: str, pattern: Pattern) -> DataFrame:
    """Search in records between any separator, NUL among them."""
    return split_lines(corpus.df.select("doc_id", "path", "text"), separator).where(pattern.matches(F.col("line")))


def multiline_docs(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """Documents in which the pattern is found across lines: the whole text is one subject, ^ and $ are lines' ends."""
    whole = pattern.with_options(multiline=True)
    return corpus.df.where(whole.matches(F.col("text"))).select("path")


def multiline_lines(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """Lines touched by a match of the whole text, each counted once."""
    whole = pattern.with_options(multiline=True).java()
    found = F.regexp_extract_all("text", F.lit(f"({whole})"), F.lit(1))
    # the text between matches, and the matches, give the lines by the newlines before them
    gaps = F.split("text", whole, -1)
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    rows = corpus.df.select("doc_id", "path", gaps.alias("gaps"), found.alias("found")).where("size(found) > 0")
    rows = rows.select("doc_id", "path", F.posexplode("found").alias("k", "match"), "gaps", "found")
    before = F.aggregate(F.slice("gaps", F.lit(1), F.col("k") + 1), F.lit(0), lambda n, x: n + newlines(x)) + F.aggregate(F.slice("found", F.lit(1), F.col("k")), F.lit(0), lambda n, x: n + newlines(x))
    first = before + 1
    # a newline at a match's end belongs to the line before
    last = first + newlines(F.regexp_replace("match", r"\n\z", ""))
    return rows.select("doc_id", "path", F.explode(F.sequence(first, last)).alias("n")).select("doc_id", "path", F.col("n").cast("long").alias("line_number")).distinct()


def stats(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """One row: files, files and lines with matches, matches, bytes."""
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    each = corpus.df.select(
        F.size(F.filter(kept, lambda x: pattern.matches(x))).cast("long").alias("lines"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(pattern.java())).cast("long")).alias("spans"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    return each.agg(
        F.count(F.lit(1)).alias("files"), F.sum((F.col("lines") > 0).cast("long")).alias("files_matched"), F.sum("lines").alias("lines_matched"), F.sum("spans").alias("matches"), F.sum("bytes").alias("bytes_searched")
    )


def dead_branches(corpus: Corpus, patterns: dict[str, Pattern]) -> DataFrame:
    """(label, files): how many documents each branch is found in; 0 names the dead ones.  One scan for all."""
    sums = corpus.df.agg(*[F.sum(F.coalesce(any_line(F.col("text"), p), F.lit(False)).cast("long")).alias(f"b{i}") for i, p in enumerate(patterns.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("files")) for i, n in enumerate(patterns)])
    return sums.select(F.inline(pairs))


def any_pattern(corpus: Corpus, patterns: list[Pattern]) -> DataFrame:
    """Lines in which any of the patterns is found, by one expression."""
    return corpus.lines().where(F.rlike("line", F.lit(either(patterns))))


def witness(corpus: Corpus, inside: Column, pattern: Pattern) -> DataFrame:
    """For a scope that has no match: the first path outside it that has one."""
    outside = corpus.df.where(~inside & any_line(F.col("text"), pattern))
    return outside.agg(F.min("path").alias("path")).where(F.col("path").isNotNull())
