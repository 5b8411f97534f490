"""Bounded samples of labelled documents, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Labels are learned from documents whose crc32(doc_id) leaves another remainder than 0.
LABEL_FOLDS = 5


def spread_hash(col: str, salt: str):
    """A number in [0, 1) fixed by the column's value."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(col)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text as binary, y) of about `per_class` documents a class at most, picked by a hash of doc_id.

    Documents of several labels count once, with the greatest.  The label rows picked are bounded by
    the sample's size, so they are sent to the scan of the documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_fold("doc_id", LABEL_FOLDS) != 0))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, per_class / max(1, counts.get(1, 0))).otherwise(per_class / max(1, counts.get(0, 0)))
    picked = known.where(spread_hash("doc_id", f"sample-{label}") < share).select(F.col("doc_id").alias("__id"), "y")
    texts = docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("binary").alias("text"))
    return texts.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("text", "y")


def held_out(fold: int, folds: int):
    """Whether a row is kept from learning; a null doc_id is never learned from and counts as held out."""
    return F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(True))
