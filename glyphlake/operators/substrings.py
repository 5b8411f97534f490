"""Substring queries: count, locate, extract, and documents laid end to end with their offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import global_rank
from .patternsets import Needles, positions


def occurrences(text: Column, needle: str) -> Column:
    """How often a string stands in a text, overlaps included; an empty one never."""
    return F.size(positions(text, needle)).cast("long") if needle else F.lit(0).cast("long")


def count(docs: DataFrame, needle: str) -> DataFrame:
    return docs.agg(F.coalesce(F.sum(occurrences(F.col("text"), needle)), F.lit(0)).alias("n"))


def tally(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, n) of documents that hold the string."""
    return docs.select("doc_id", occurrences(F.col("text"), needle).alias("n")).where("n > 0")


def locate(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, pos) ascending, from 0."""
    return Needles([needle]).occurrences(docs).select("doc_id", F.col("start").alias("pos"))


def suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """The suffix array of a text of code points, by doubling the compared length.

    The first comparison is of as many characters as one number holds, and later rounds only order the suffixes that are
    still equal to others."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    letters, rank = np.unique(codes, return_inverse=True)
    room, base, size = rank.astype(np.int64) + 1, len(letters) + 1, 1
    while base * base < 1 << 62 and size < n:
        room = room * base + np.concatenate([room[size:], np.zeros(min(size, n), np.int64)])
        base, size = base * base, size * 2
    order = np.argsort(room, kind="stable")
    new = np.concatenate([[True], np.diff(room[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of a group of equal ones
    while True:
        # places of groups of more than one
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        behind = np.where(at + size < n, rank[np.minimum(at + size, n - 1)], -1)
        key = rank[at] * (n + 1) + behind + 1
        sorting = np.argsort(key, kind="stable")
        order[tied], key = at[sorting], key[sorting]
        starts = np.concatenate([[True], np.diff(key) != 0])
        new[tied] = starts
        rank[order[tied]] = np.maximum.accumulate(np.where(starts, tied, 0))
        size *= 2


class Codex:
    """A text's suffixes in order, as its last column: strings are counted from their last character backwards."""

    def __init__(self, text: str):
        codes = np.concatenate([np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1, [0]])
        self.order = suffix_ranks(codes)
        self.last = codes[self.order - 1]
        self.sorted, starts = np.unique(self.last, return_index=False, return_counts=True)
        self.first = dict(zip(self.sorted.tolist(), (np.cumsum(starts) - starts).tolist(), strict=True))
        self.places: dict[int, np.ndarray] = {}

    def whole(self) -> tuple[int, int]:
        return 0, len(self.last)

    def extend(self, rows: tuple[int, int], character: str) -> tuple[int, int]:
        """The rows that begin with a character and what the given rows begin with."""
        c = ord(character) + 1
        if c not in self.first:
            return 0, 0
        if c not in self.places:  # its places in the last column, ascending: how many stand before a row
            self.places[c] = np.flatnonzero(self.last == c)
        low, high = np.searchsorted(self.places[c], rows).tolist()
        return self.first[c] + low, self.first[c] + high

    def count(self, needle: str) -> int:
        rows = self.whole()
        for character in reversed(needle):
            rows = self.extend(rows, character)
        return rows[1] - rows[0]


def backward_counts(docs: DataFrame, needles: list[str]) -> DataFrame:
    """(doc_id, needle_id, n): how often each string stands in each text, for many strings over one index a text."""

    @F.pandas_udf("array<long>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda text: [c.count(x) for c in [Codex(text or "")] for x in needles])

    return docs.select("doc_id", F.posexplode(count("text")).alias("needle_id", "n")).where("n > 0")


def extract(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start + 1, length)


def shelf(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop): places of documents laid end to end by id, one separator between them.

    Rows without an id come last, rows of one id in the order of their texts' hashes.  The running sum goes over a table
    of sizes, first within ranges of ids and then over the ranges."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    sizes = docs.select("doc_id", size.alias("size"), F.xxhash64("text").alias("h"), (size + 1).alias("room"))
    placed = global_rank(sizes, [F.col("doc_id").asc_nulls_last(), "h", "size"], "start", "shelf", "room")
    return placed.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("stop"))


def document_at(places: DataFrame, catalog: DataFrame, pos: str = "pos") -> DataFrame:
    """The document of each place: an as-of join done as a union and a running maximum in ranges of places.

    Places on a separator belong to the document before it."""
    starts = catalog.select(F.col("start").alias("at"), F.col("doc_id").alias("doc"), F.col("start").alias("first"), F.lit(None).cast("long").alias(pos))
    asked = places.select(F.col(pos).alias("at"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("first"), F.col(pos).alias(pos))
    both = starts.unionByName(asked)
    # fixed-width ranges, each opened by the document that reaches into it
    width = 1 << 20
    both = both.withColumn("range", F.floor(F.col("at") / width))
    reaching = catalog.select(F.explode(F.sequence(F.floor(F.col("start") / width) + 1, F.greatest(F.floor(F.col("start") / width) + 1, F.floor(F.col("stop") / width)))).alias("range"), "start", "stop", "doc_id")
    reaching = reaching.where(F.col("range") * width <= F.col("stop")).select((F.col("range") * width).alias("at"), F.col("doc_id").alias("doc"), F.col("start").alias("first"), F.lit(None).cast("long").alias(pos), "range")
    order = Window.partitionBy("range").orderBy("at", F.col(pos).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # a document without an id is one as well, so the two are carried together
    known = F.last(F.when(F.col("first").isNotNull(), F.struct("doc", "first")), ignorenulls=True).over(order)
    filled = both.unionByName(reaching).select(pos, known.alias("d")).select(pos, F.col("d.doc").alias("doc_id"), F.col("d.first").alias("start"))
    return filled.where(F.col(pos).isNotNull()).select(pos, "doc_id", (F.col(pos) - F.col("start")).alias("offset"))


def balanced_bounds(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Rows in order, cut into shards from 1 whose sizes differ by at most one, the larger first."""
    ranked = global_rank(rows, order, "__rank")
    n = ranked.count()
    small, large = divmod(n, shards)
    edge = large * (small + 1)
    shard = F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (small + 1))).otherwise(large + F.floor((F.col("__rank") - edge) / max(1, small)))
    return ranked.select(*rows.columns, (shard + 1).cast("long").alias("shard"))
