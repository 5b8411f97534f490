"""Ranking of documents by reciprocal rank fusion of several orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.paths import depth, is_generated, is_mirror
from ..functions.patterns import Pattern
from ..storage import global_rank
from .search import matching_lines, snippet


@dataclass(frozen=True)
class Weights:
    """Fixed values of the fusion."""

    k: float = 60.0
    lexical: float = 1.0
    symbol: float = 2.0
    structure: float = 0.75
    shallow: float = 0.25
    graph: float = 1.0
    authored: float = 3.0


def reciprocal(rank: Column, weight: float, k: float) -> Column:
    """The part of a document at a rank from 0."""
    return F.lit(weight) / (F.lit(k) + rank)


def fuse(features: DataFrame, weights: Weights = Weights(), external: DataFrame | None = None) -> DataFrame:
    """Scores of documents with matches, best_line, definition (0 to 3), shape, depth, is_generated and is_mirror.

    Orders are total: ties end at doc_id.  external is another ranking (doc_id, position from 0).  The orders are
    global ranks over slim rows, sorted by ranges; shapes are counted before they are joined back."""
    w = weights
    rows = global_rank(features, [F.desc("matches"), "best_line", "doc_id"], "__lexical")
    rows = global_rank(rows, ["depth", "best_line", "doc_id"], "__shallow")
    shapes = rows.where("shape <> 0").groupBy("shape").agg(F.count(F.lit(1)).alias("__alike"))
    total = shapes.agg(F.coalesce(F.sum("__alike"), F.lit(0)).alias("__shaped"))
    rows = rows.join(shapes, "shape", "left").crossJoin(F.broadcast(total))  # one row
    symbol = F.lit(w.symbol / w.k / 3) * F.col("definition")
    shaped = F.col("__shaped").cast("double")
    structure = F.when((F.col("shape") != 0) & (F.col("__shaped") > 1), F.lit(w.structure / w.k) * F.log2(shaped / F.col("__alike")) / F.log2(shaped)).otherwise(0.0)
    authored = F.when(~F.col("is_generated") & ~F.col("is_mirror"), F.lit(w.authored / w.k)).otherwise(0.0)
    score = reciprocal(F.col("__lexical"), w.lexical, w.k) + symbol + structure + reciprocal(F.col("__shallow"), w.shallow, w.k) + authored
    if external is not None:
        rows = rows.join(external.select("doc_id", "position"), "doc_id", "left")
        score = score + F.coalesce(reciprocal(F.col("position"), w.graph, w.k), F.lit(0.0))
    return rows.withColumn("score", score).select(*features.columns, "score")


def top(scored: DataFrame, most: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id").limit(most)


def definition_pattern(needle: str) -> Pattern:
    """Lines that declare a name: a declaring word, or an assignment to it at the line's start."""
    name = Pattern(needle, fixed=True).body()
    words = "def|fn|func|function|class|struct|enum|trait|interface|type|const|let|var|val|module|mod|package|namespace|impl|macro_rules!"
    return Pattern(rf"(?:^|\s)(?:{words})\s+{name}(?![A-Za-z0-9_])|^\s*{name}\s*(?::=|=|:)(?!=)")


def comment_free(line: Column) -> Column:
    """Whether a line is more than a comment."""
    return ~F.rlike(line, F.lit(r"\A\s*(?://|#|/\*|\*|\\\\)"))


def confidence(line: Column, needle: str) -> Column:
    """3 a declaring word before the name, 2 an assignment to it, 1 the name at the line's start, else 0; none in comments."""
    name = Pattern(needle, fixed=True).body()
    words = "def|fn|func|function|class|struct|enum|trait|interface|type|const|let|var|val|module|mod|package|namespace|impl"
    text = F.regexp_replace(line, r"\A\s+", "")
    comment = F.rlike(text, F.lit(r"\A(?://|#|/\*|\*|\\\\)"))
    return (
        F.when(comment, 0).when(F.rlike(text, F.lit(rf"(?:\A|\s)(?:{words})\s+{name}(?![A-Za-z0-9_])")), 3).when(F.rlike(text, F.lit(rf"\A{name}\s*(?::=|=(?!=)|:)")), 2)
        .when(F.rlike(text, F.lit(rf"\A{name}(?![A-Za-z0-9_])")), 1).otherwise(0)
    )


def shape(line: Column, needle: str) -> Column:
    """A number for a line's shape: the needle Q, other names I, numbers N, strings S, and punctuation; 0 without the
    needle or in a comment; what follows a comment mark does not count."""
    name = Pattern(needle, fixed=True).body()
    text = F.regexp_replace(line, r"\A\s+", "")
    cut = F.regexp_replace(text, r"(?://|#).*\z", "")
    marked = F.regexp_replace(cut, rf"(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])", "\x01")
    tokens = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r"\"[^\"]*\"|'[^']*'", "\x02"), r"[A-Za-z_][A-Za-z0-9_]*", "I"), r"[0-9][0-9A-Za-z_.]*", "N")
    form = F.translate(F.regexp_replace(tokens, r"\s+", ""), "\x01\x02", "QS")
    return F.when(F.contains(marked, F.lit("\x01")) & ~F.rlike(text, F.lit(r"\A(?://|#|/\*|\*)")), F.xxhash64(form)).otherwise(F.lit(0).cast("long"))


def file_features(corpus: Corpus, pattern: Pattern, needle: str) -> DataFrame:
    """Per matching document what the fusion ranks, from one pass over its matching lines."""
    lines = matching_lines(corpus, pattern).withColumn("c", confidence(F.col("line"), needle))
    best = F.min_by(F.struct("line_number", "line"), F.struct(-F.col("c"), F.col("line_number")))
    per = lines.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("matches"), F.max("c").alias("definition"), best.alias("best"))
    known = corpus.df.select("doc_id", is_generated(F.col("path"), F.col("text")).alias("is_generated"), is_mirror(F.col("path")).alias("is_mirror"))
    rows = per.join(known, "doc_id")
    return rows.select(
        "doc_id", "path", "matches", "definition", F.col("best.line_number").alias("best_line"), F.col("best.line").alias("line"), shape(F.col("best.line"), needle).alias("shape"), depth(F.col("path")).alias("depth"), "is_generated", "is_mirror"
    )


def ranked_view(corpus: Corpus, pattern: Pattern, needle: str, most: int = 20, weights: Weights = Weights()) -> DataFrame:
    """(path, line_number, kind, count, snippet) of the best documents."""
    kind = F.when(F.col("is_mirror"), "mirror").when(F.col("is_generated"), "generated").when(F.col("definition") > 1, "definition").otherwise("use")
    best = top(fuse(file_features(corpus, pattern, needle), weights), most)
    return best.select("path", F.col("best_line").alias("line_number"), kind.alias("kind"), F.col("matches").alias("count"), snippet(F.col("line"), pattern).alias("snippet"), "score")


def canonical_of_mirrors(corpus: Corpus) -> DataFrame:
    """(doc_id, canonical): the first document with the same content that is neither mirror nor generated.

    Aggregated by content first, so that a content with many copies is one row to join with."""
    rows = corpus.df.select("doc_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("size"), (is_mirror(F.col("path")) | is_generated(F.col("path"), F.col("text"))).alias("derived"))
    firsts = rows.where(~F.col("derived")).groupBy("digest", "size").agg(F.min("doc_id").alias("canonical"))
    return rows.join(firsts, ["digest", "size"]).where("canonical <> doc_id").select("doc_id", "canonical")
