"""A search session: settings, budgets, cancellation, and answers kept while the corpus stays the same."""

from __future__ import annotations

import fnmatch
import hashlib
import threading
import tomllib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from .functions.paths import PathFilter

ANSWER_BYTES, KEPT_BYTES = 8 << 20, 64 << 20


@dataclass(frozen=True)
class Settings:
    """What a tree's committed settings file says about its corpus."""

    roots: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    types: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @classmethod
    def parse(cls, text: str) -> Settings:
        """TOML with roots, exclude, skip and a table of types; unknown keys are an error."""
        raw = tomllib.loads(text)
        unknown = set(raw) - {"roots", "exclude", "skip", "types"}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(tuple(raw.get("roots", ())), tuple(raw.get("exclude", ())), tuple(raw.get("skip", ())), tuple((k, tuple(v)) for k, v in raw.get("types", {}).items()))

    @staticmethod
    def governing(paths: list[str], place: str) -> str | None:
        """Of several settings files the one in the nearest folder above a place."""
        above = [p for p in paths if not (folder := p.rpartition("/")[0]) or place == folder or place.startswith(folder + "/")]
        return max(above, key=lambda p: p.count("/"), default=None)

    def filter(self) -> PathFilter:
        return PathFilter(roots=self.roots, exclude=(*self.exclude, *(f"{s}/" for s in self.skip)))

    def skips(self, name: str) -> bool:
        return any(fnmatch.fnmatchcase(name, s) for s in self.skip)


@dataclass
class Answers:
    """Results by question and snapshot, the least recently used forgotten first; large ones are not kept."""

    most: int = KEPT_BYTES
    each: int = ANSWER_BYTES
    kept: OrderedDict[str, tuple[int, list[Row]]] = field(default_factory=OrderedDict)
    hits: int = 0

    def get(self, snapshot: str, question: str, ask: Callable[[], DataFrame]) -> list[Row]:
        key = hashlib.sha256(f"{snapshot}\0{question}".encode()).hexdigest()
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key][1]
        rows = ask().collect()
        size = sum(len(repr(r)) for r in rows)
        if size <= self.each:
            self.kept[key] = (size, rows)
            while sum(s for s, _ in self.kept.values()) > self.most:
                self.kept.popitem(last=False)
        return rows


@contextmanager
def budget(spark: SparkSession, seconds: float | None = None) -> Iterator[str]:
    """Jobs started inside are one group, which is cancelled when the time is over; yields the group's name."""
    group = f"search-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context.setJobGroup(group, "search", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: context.cancelJobGroup(group)) if seconds is not None else None
    if timer:
        timer.daemon = True
        timer.start()
    try:
        yield group
    finally:
        if timer:
            timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def rows(df: DataFrame, most: int | None = None) -> Iterator[Row]:
    """A pull cursor over a result, a partition at a time; stops at `most` rows."""
    return (df if most is None else df.limit(most)).toLocalIterator()


def push(df: DataFrame, sink: Callable[[Row], bool]) -> int:
    """Rows pushed into a sink until it says stop by returning true; how many were taken."""
    taken = 0
    for row in df.toLocalIterator():
        taken += 1
        if sink(row):
            break
    return taken


def each_partition(df: DataFrame, write: Callable[[Iterator[Row]], None]) -> None:
    """Rows written where they are, a partition a call; the sink must allow a partition to come again."""
    df.foreachPartition(write)
