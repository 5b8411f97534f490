"""Functions as units of text, and the questions asked about them: concepts, context, provenance and blast radius.

Units are cut where a declaring line stands, by windows over a document's lines; sketches of units then answer as those
of documents do.  Exact sets narrow first, likeness is only computed inside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..storage import materialize
from . import kinship
from .ranking import comment_free

DECLARES = r"(?:^|\s)(?:def|fn|func|function|class|struct|enum|trait|interface|impl)\s+([A-Za-z_][A-Za-z0-9_]*)"


def functions(corpus: Corpus, least_lines: int = 2) -> DataFrame:
    """(doc_id, path, line_start, line_end, headline, text) of the stretches from one declaring line to the next."""
    order = Window.partitionBy("doc_id").orderBy("line_number")
    lines = corpus.lines().withColumn("declares", F.rlike("line", F.lit(DECLARES)) & comment_free(F.col("line")))
    numbered = lines.withColumn("unit", F.sum(F.col("declares").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("unit > 0")
    # a unit's blank last lines are not part of it
    filled = numbered.withColumn("last", F.max(F.when(F.trim("line") != "", F.col("line_number"))).over(Window.partitionBy("doc_id", "unit"))).where("line_number <= last")
    grouped = filled.groupBy("doc_id", "path", "unit").agg(F.sort_array(F.collect_list(F.struct("line_number", "line"))).alias("l"))
    out = grouped.select(
        "doc_id", "path", F.col("l")[0]["line_number"].alias("line_start"), F.element_at("l", -1)["line_number"].alias("line_end"), F.trim(F.col("l")[0]["line"]).alias("headline"),
        F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"),
    )
    return out.where(F.col("line_end") - F.col("line_start") + 1 >= least_lines)


def region_id(units: DataFrame) -> DataFrame:
    """Units as documents: their path also says their lines."""
    return units.withColumn("path", F.concat("path", F.lit("#"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")))


def concepts(corpus: Corpus, threshold: float = 0.25) -> DataFrame:
    """Families of functions of one shape: label, members, repeated lines, the loosest structure distance."""
    units = region_id(functions(corpus))
    known = kinship.sketches(units)
    families = kinship.families(known, threshold, "shapes").select("label", F.explode("members").alias("path"), "edge")
    sized = families.join(units.select("path", (F.col("line_end") - F.col("line_start") + 1).alias("lines")), "path")
    return sized.groupBy("label").agg(F.sort_array(F.collect_list("path")).alias("members"), (F.sum("lines") - F.max("lines")).alias("repeated_lines"), F.max("edge").alias("structure_distance"))


def context(corpus: Corpus, symbol: str, most: int = 10) -> DataFrame:
    """(path, line_start, line_end, headline, uses): functions that use a symbol, those that use it most first."""
    units = functions(corpus).where(F.contains("text", F.lit(symbol)))
    uses = F.regexp_count("text", F.lit(rf"(?<![A-Za-z0-9_])\Q{symbol}\E(?![A-Za-z0-9_])")).cast("long")
    return units.select("path", "line_start", "line_end", "headline", uses.alias("uses")).where("uses > 0").orderBy(F.desc("uses"), "path", "line_start").limit(most)


def enclosing(corpus: Corpus, path: str, line: int) -> DataFrame:
    """The function around a line."""
    return functions(Corpus(corpus.df.where(F.col("path") == path)), 1).where((F.col("line_start") <= line) & (F.col("line_end") >= line)).select("path", "line_start", "line_end", "headline")


def provenance(corpus: Corpus, text: str, least: int = 16) -> DataFrame:
    """(text, occurrences, source, line, verified): where a text's maximal phrases stand, first source first."""
    found = kinship.quote(corpus.df, text, least)
    bodies = corpus.df.select(F.col("path").alias("source"), F.col("text").alias("body"))
    at = F.expr("instr(body, text)")
    line = F.length(F.expr("left(body, instr(body, text) - 1)")) - F.length(F.replace(F.expr("left(body, instr(body, text) - 1)"), F.lit("\n"), F.lit(""))) + 1
    return found.join(bodies, "source").select("text", "occurrences", "source", line.cast("long").alias("line"), (at > 0).alias("verified"))


def blast(corpus: Corpus, symbol: str, hops: int = 2) -> DataFrame:
    """(role, path, line, detail): what a change of a symbol touches - definitions, dependents, dependencies, ripples, comments."""
    # the texts may be made by expressions, which each of the six readings below would evaluate again
    corpus = Corpus(materialize(corpus.df.select("doc_id", "path", "text"), "blast"))
    lines = corpus.lines()
    known = materialize(kinship.references(lines, symbol), "references")
    definitions = known.where("defines").select(F.lit("definition").alias("role"), "path", "line", F.lit("").alias("detail"))
    dependents = known.where("not defines").select(F.lit("dependent").alias("role"), "path", "line", F.lit("").alias("detail"))
    own = known.where("defines").select("path", F.col("line").alias("at"))
    # units are cut by document, so those without a definition of the symbol are left out first
    defining = Corpus(corpus.df.join(own.select("path").distinct(), "path", "left_semi"))
    units = functions(defining, 1).join(own, "path").where((F.col("line_start") <= F.col("at")) & (F.col("line_end") >= F.col("at")))
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})\s*\("), F.lit(1))))
    dependencies = units.select("path", F.col("line_start").alias("line"), names.alias("detail")).where(F.col("detail") != symbol).select(F.lit("dependency").alias("role"), "path", "line", "detail").distinct()
    ripple = kinship.ripple(lines, symbol, hops).where("hops > 1").select(F.lit("ripple").alias("role"), "path", F.col("hops").alias("line"), F.col("via").alias("detail"))
    comments = lines.where(F.contains("line", F.lit(symbol)) & ~comment_free(F.col("line"))).select(F.lit("comment").alias("role"), "path", F.col("line_number").alias("line"), F.trim("line").alias("detail"))
    return definitions.unionByName(dependents).unionByName(dependencies).unionByName(ripple).unionByName(comments)
