"""The corpus: a DataFrame of documents with an id, a path and a text.

Everything else is computed from these columns with DataFrame operations, so scans stay pruned to
what a query reads: a census never touches the bodies, a recall is a point filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a document that is still a member of a corpus.
MEMBER_BYTES = 4 << 20
#: Bytes at the start of a document in which a NUL makes it binary.
BINARY_BYTES = 8192


@dataclass(frozen=True)
class Corpus:
    """A DataFrame with the columns doc_id, path and text (and any others)."""

    df: DataFrame

    @classmethod
    def from_documents(cls, documents: DataFrame) -> Corpus:
        """The documents table, with a path built from source, language and id."""
        path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return cls(documents.withColumn("path", path))

    @classmethod
    def from_pages(cls, pages: DataFrame) -> Corpus:
        """Web pages: the url without its scheme is the path, the markup is the text."""
        return cls(pages.select(F.col("page_id").alias("doc_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("html").alias("text")))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[tuple[int, str, str | None]]) -> Corpus:
        """Documents held by the caller, standard input among them."""
        return cls(spark.createDataFrame(rows, "doc_id long, path string, text string"))

    def members(self, cap: int = MEMBER_BYTES) -> Corpus:
        """Readable, not empty, not binary, at most `cap` bytes."""
        return Corpus(self.df.where(F.octet_length("text").between(1, cap) & ~is_binary(F.col("text"))))

    def census(self) -> DataFrame:
        """Paths and sizes without bodies; an unreadable body counts as empty."""
        return self.df.select("doc_id", "path", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))

    def recall(self, doc_id: int) -> DataFrame:
        return self.df.where(F.col("doc_id") == doc_id)

    def where(self, condition: Column) -> Corpus:
        return Corpus(self.df.where(condition))

    def lines(self, separator: str = "\n", crlf: bool = False) -> DataFrame:
        """(doc_id, path, line_number, line): numbers from 1; a final separator does not start another line.

        With crlf a carriage return before the separator belongs to the line's end."""
        return split_lines(self.df.select("doc_id", "path", "text"), separator, crlf)


def is_binary(text: Column) -> Column:
    return F.contains(F.left(text, F.lit(BINARY_BYTES)), F.lit("\0"))


def split_lines(df: DataFrame, separator: str = "\n", crlf: bool = False, text: str = "text") -> DataFrame:
    """Replace the text column by line_number and line, one row a line."""
    parts = F.split(F.col(text), _quoted(separator), -1)
    # the part behind a final separator is not a line; an empty text has none
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    others = [c for c in df.columns if c != text]
    out = df.select(*others, F.posexplode(kept).alias("__at", "line"))
    line = F.regexp_replace("line", "\r$", "") if crlf else F.col("line")
    return out.select(*others, (F.col("__at") + 1).cast("long").alias("line_number"), line.alias("line"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def line_grid(lines: DataFrame) -> DataFrame:
    """Byte offsets of each line: start, content_end (keeps a carriage return) and term_end (behind the newline)."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line").cast("long")
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0).cast("long"))
    grid = lines.withColumn("start", start).withColumn("content_end", F.col("start") + size)
    return grid.withColumn("term_end", F.col("content_end") + 1)
