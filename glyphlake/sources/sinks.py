"""Output forms of matches: text rows, JSON records, budgets, and a manifest with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus, line_grid
from ..functions.patterns import Pattern
from ..operators.search import matching_lines, with_context

SOFT_BUDGET, HARD_BUDGET = 100 << 10, 256 << 20


def text_rows(lines: DataFrame, *, filename: bool = True, line_number: bool = True, column: bool = False, separator: str = ":") -> DataFrame:
    """path:line:column:text, the parts as asked for."""
    parts = [F.col("path")] * filename + [F.col("line_number").cast("string")] * line_number + [F.col("column").cast("string")] * column + [F.col("line")]
    return lines.select(F.concat_ws(separator, *parts).alias("value"))


def vimgrep(corpus: Corpus, pattern: Pattern) -> DataFrame:
    """One row a match: path:line:column:text, columns in bytes from 1."""
    lines = matching_lines(corpus, pattern)
    java = pattern.java()
    found = F.regexp_extract_all("line", F.lit(f"({java})"), F.lit(1))
    gaps = F.split("line", java, -1)
    rows = lines.select("path", "line_number", "line", F.posexplode(found).alias("k", "match"), found.alias("found"), gaps.alias("gaps")).where("match <> ''")
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.octet_length(x))
    column = size(F.slice("gaps", F.lit(1), F.col("k") + 1)) + size(F.slice("found", F.lit(1), F.col("k"))) + 1
    return rows.select(F.concat_ws(":", "path", "line_number", column.cast("string"), "line").alias("value"))


def submatches(line: Column, pattern: Pattern) -> Column:
    """The matches on a line as (match, start, end), in bytes from 0; empty ones are left out."""
    java = pattern.java()
    found, gaps = F.regexp_extract_all(line, F.lit(f"({java})"), F.lit(1)), F.split(line, java, -1)
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.octet_length(x))

    def span(match: Column, k: Column) -> Column:
        start = size(F.slice(gaps, F.lit(1), k + 1)) + size(F.slice(found, F.lit(1), k))
        return F.struct(F.struct(match.alias("text")).alias("match"), start.alias("start"), (start + F.octet_length(match)).alias("end"))

    return F.transform(F.filter(found, lambda m: m != ""), span)


def json_records(corpus: Corpus, pattern: Pattern, before: int = 0, after: int = 0) -> DataFrame:
    """(path, ordinal, record): begin, match, context and end records of each file that matches, and a last summary
    (path null), as JSON.  Offsets and spans are in bytes, a file's statistics stand in its end record."""
    rows = with_context(corpus.lines(), pattern.matches(F.col("line")), before, after) if before or after else matching_lines(corpus, pattern).withColumn("kind", F.lit("match"))
    grid = line_grid(corpus.lines()).select("doc_id", "line_number", F.col("start").alias("absolute_offset"))
    lines = rows.select("doc_id", "path", "line_number", "line", "kind").join(grid, ["doc_id", "line_number"])
    own = F.when(F.col("kind") == "match", submatches(F.col("line"), pattern)).otherwise(F.array().cast("array<struct<match:struct<text:string>,start:int,end:int>>"))
    lines = lines.withColumn("submatches", own)
    text = F.struct(F.concat("line", F.lit("\n")).alias("text")).alias("lines")
    of = F.struct(F.struct(F.col("path").alias("text")).alias("path"), text, "line_number", "absolute_offset", "submatches")
    body = lines.select("path", F.col("line_number").alias("ordinal"), F.to_json(F.struct(F.col("kind").alias("type"), of.alias("data"))).alias("record"))
    per = lines.where("kind = 'match'").groupBy("path").agg(F.count(F.lit(1)).alias("matched_lines"), F.sum(F.size("submatches")).alias("matches"))
    name = F.struct(F.struct(F.col("path").alias("text")).alias("path"))
    begin = per.select("path", F.lit(0).cast("long").alias("ordinal"), F.to_json(F.struct(F.lit("begin").alias("type"), name.alias("data"))).alias("record"))
    stats = F.struct(F.struct(F.col("path").alias("text")).alias("path"), F.struct("matched_lines", "matches").alias("stats"))
    end = per.select("path", F.lit(2**62).cast("long").alias("ordinal"), F.to_json(F.struct(F.lit("end").alias("type"), stats.alias("data"))).alias("record"))
    total = per.agg(F.count(F.lit(1)).alias("searches_with_match"), F.coalesce(F.sum("matched_lines"), F.lit(0)).alias("matched_lines"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"))
    summary = F.struct(F.lit("summary").alias("type"), F.struct(F.struct("searches_with_match", "matched_lines", "matches").alias("stats")).alias("data"))
    last = total.select(F.lit(None).cast("string").alias("path"), F.lit(2**62 + 1).cast("long").alias("ordinal"), F.to_json(summary).alias("record"))
    return begin.unionByName(body).unionByName(end).unionByName(last)


def within_budget(rows: DataFrame, size: Column, order: list[str], budget: int, group: str) -> DataFrame:
    """The first rows of each group, in order, whose sizes add up to the budget at most."""
    running = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__used", running).where(F.col("__used") <= budget).drop("__used")


def headed(lines: DataFrame, context: bool = False) -> DataFrame:
    """(path, ordinal, value): each file's path on a row of its own, then its lines; with context, match lines have a
    colon behind their number, others a dash, and -- stands between bands."""
    mark = F.when(F.col("kind") == "match", ":").otherwise("-") if context else F.lit(":")
    rows = lines.select("path", (F.col("line_number") * 2 + 1).alias("ordinal"), F.concat(F.col("line_number").cast("string"), mark, F.col("line")).alias("value"))
    heads = lines.select("path").distinct().select("path", F.lit(0).cast("long").alias("ordinal"), F.col("path").alias("value"))
    out = heads.unionByName(rows)
    if context:
        gaps = lines.where("band > 1").groupBy("path", "band").agg((F.min("line_number") * 2).alias("ordinal")).select("path", "ordinal", F.lit("--").alias("value"))
        out = out.unionByName(gaps)
    return out


def null_separated(lines: DataFrame) -> DataFrame:
    """path NUL line:text, for programs that take any path."""
    return lines.select(F.concat(F.col("path"), F.lit("\0"), F.col("line_number").cast("string"), F.lit(":"), F.col("line")).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    rows.select("value").write.text(path)


def manifest(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-free digest of a table's content, to be kept beside it and compared at load."""
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    # the sum of the digests' first 15 hex digits does not depend on order and fits a decimal
    return df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)").alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.sum("d").alias("digest"))
