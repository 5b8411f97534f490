"""Keeping an index and its answers fresh over a changing corpus, with Structured Streaming.

A stream of changed files (doc_id, path, text, mtime, deleted) is merged into the postings by foreachBatch; late
files are re-read, never dropped, so there is no watermark on them.  Windowed counts of events do have one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import Pattern
from ..operators.indexes import posting_lists, publish, published, unlisted, write_lists


def latest(changes: DataFrame) -> DataFrame:
    """One row a document: its last change; equal clocks are decided by deletion, then text."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("mtime"), F.desc("deleted"), "text")
    return changes.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


@dataclass
class IndexKeeper:
    """A postings table in segments: a batch adds a segment of its changed documents and the ids that it replaces or
    deletes, and then moves the pointer, which names the segments.  A row counts if no later segment names its document.
    When there are `most` segments, they are written as one."""

    spark: SparkSession
    root: str
    most: int = 8

    def segments(self) -> list[str]:
        """Names of the segments, oldest first; the last one ends in the number of the last batch."""
        target = published(self.spark, self.root)
        return target.split(",") if target else []

    def _live(self, kind: str, names: list[str]) -> DataFrame:
        out = gone = None
        for k, name in enumerate(names):
            rows = self.spark.read.parquet(f"{self.root}/{kind}-{name}")
            rows = (unlisted(rows) if kind == "postings" else rows).withColumn("__segment", F.lit(k))
            ids = self.spark.read.parquet(f"{self.root}/gone-{name}").withColumn("__last", F.lit(k))
            out, gone = (rows, ids) if out is None else (out.unionByName(rows), gone.unionByName(ids))
        last = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.max("__last").alias("__last"))
        kept = out.join(last, F.col("doc_id") == F.col("__id"), "left").where(F.col("__last").isNull() | (F.col("__segment") >= F.col("__last")))
        return kept.drop("__segment", "__id", "__last")

    def current(self) -> tuple[int, DataFrame | None, DataFrame | None]:
        names = self.segments()
        if not names:
            return -1, None, None
        return int(names[-1].rpartition("-")[2]), self._live("postings", names), self._live("docs", names)

    def _write(self, name: str, lists: DataFrame, docs: DataFrame, gone: DataFrame) -> None:
        write_lists(lists, f"{self.root}/postings-{name}", "overwrite")
        docs.write.mode("overwrite").parquet(f"{self.root}/docs-{name}")
        gone.write.mode("overwrite").parquet(f"{self.root}/gone-{name}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Upserts and deletions of a batch; one that comes again after it was published is left out."""
        names = self.segments()
        if names and int(names[-1].rpartition("-")[2]) >= batch_id:
            return
        last = latest(batch)
        kept = last.where(~F.col("deleted")).select("doc_id", "path", "text")
        self._write(f"batch-{batch_id}", posting_lists(kept), kept, last.select("doc_id"))
        names = [*names, f"batch-{batch_id}"]
        if len(names) >= self.most:
            # lists of a bounded share of a trigram's documents
            live = self._live("postings", names).groupBy("trigram", F.pmod(F.xxhash64("doc_id"), F.lit(256))).agg(F.collect_list("doc_id").alias("docs")).select("trigram", "docs")
            self._write(f"whole-{batch_id}", live, self._live("docs", names), last.select("doc_id").limit(0))
            names = [f"whole-{batch_id}"]
        publish(self.spark, self.root, ",".join(names))

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change records dropped as Parquet files into a folder."""
    return spark.readStream.schema("doc_id long, path string, text string, mtime timestamp, deleted boolean").parquet(folder)


def live_matches(changes: DataFrame, pattern: Pattern) -> DataFrame:
    """Matching lines of changed documents as they arrive."""
    parts = changes.where(~F.col("deleted")).select("doc_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return parts.where(pattern.matches(F.col("line"))).select("doc_id", "path", (F.col("at") + 1).cast("long").alias("line_number"), "line")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
