"""Snapshots of a tree and what changed between them: folders, stored bodies, a journal, and windows without changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folders(files: DataFrame) -> DataFrame:
    """(folder, files, bytes, digest) for every folder above a file (path, size, and mtime if there is one), the root ''.

    A digest is a sum of the files' hashes below, so it combines before rows move and doesn't depend on their order."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    own = F.xxhash64(*[c for c in ("path", "size", "mtime") if c in files.columns]).cast("decimal(38,0)")
    rows = files.select(F.explode(above).alias("folder"), F.col("size").cast("long").alias("size"), own.alias("h"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("h").alias("digest"))


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """(folder): folders of either snapshot whose digests differ; a walk needs to enter no others."""
    before, after = old.select("folder", F.col("digest").alias("was")), new.select("folder", F.col("digest").alias("now"))
    return before.join(after, "folder", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("folder")


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def store_bodies(docs: DataFrame, path: str) -> None:
    """Write each body once, by the digest of its content, so that unchanged documents are read from there."""
    bodies = docs.where(F.col("text").isNotNull()).select(content_key(F.col("text")).alias("digest"), "text").dropDuplicates(["digest"])
    bodies.repartitionByRange("digest").sortWithinPartitions("digest").write.mode("errorifexists").parquet(path)


def bodies_of(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents (with a digest) with their stored bodies; null where there is none."""
    return docs.join(stored.select(F.col("digest").alias("__d"), "text"), F.col("digest") == F.col("__d"), "left").drop("__d")


def journal(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, op) of what turns one table of documents into the other: insert, update or delete; rows without a key are left out."""
    before = old.select(F.col(key).alias("__k"), content_key(F.col("text")).alias("was")).where("__k is not null")
    after = new.select(F.col(key), content_key(F.col("text")).alias("now")).where(F.col(key).isNotNull())
    both = before.join(after, F.col("__k") == F.col(key), "full")
    op = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "update")
    return both.select(F.coalesce(key, "__k").alias(key), op.alias("op")).where("op is not null")


def replay(old: DataFrame, changes: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The old documents with a journal's changes, their bodies taken from the new table."""
    kept = old.join(changes.select(key), key, "left_anti")
    return kept.unionByName(new.join(changes.where("op <> 'delete'").select(key), key, "left_semi").select(*old.columns))


def clean_windows(changes: DataFrame, clock: str, every: str = "1 hour") -> DataFrame:
    """(start): windows between the first and the last change of the journal in which nothing changed: answers kept in one hold."""
    busy = changes.where(F.col(clock).isNotNull()).select(F.window(clock, every)["start"].alias("start")).distinct()
    span = busy.agg(F.min("start").alias("low"), F.max("start").alias("high")).where("low is not null")
    every_one = span.select(F.explode(F.sequence("low", "high", F.expr(f"interval {every}"))).alias("start"))
    return every_one.join(busy, "start", "left_anti")
