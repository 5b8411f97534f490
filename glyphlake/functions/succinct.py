"""Bit sets, balanced parentheses and sorted word sets as columns."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(bits: Column) -> Column:
    return F.bit_count(bits).cast("long")


def rank(bits: Column, place: Column | int) -> Column:
    """Ones below a place of a 64-bit set."""
    at = F.lit(place) if isinstance(place, int) else place
    all_ones = F.lit(-1).cast("long")
    mask = F.when(at <= 0, F.lit(0).cast("long")).when(at >= 64, all_ones).otherwise(F.call_function("shiftrightunsigned", all_ones, (F.lit(64) - at).cast("int")))
    return F.bit_count(bits.bitwiseAND(mask)).cast("long")


def select(bits: Column, k: Column | int) -> Column:
    """The place of the k-th one, from 0; null if there are not so many."""
    n = F.lit(k) if isinstance(k, int) else k
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return F.when(n < F.size(ones), F.element_at(ones, (n + 1).cast("int"))).cast("long")


def mask_of(numbers: Column) -> Column:
    """The set of an array of numbers below 64."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def _parentheses(column: pd.Series) -> pd.Series:
    def of(text: str | None) -> list[dict] | None:
        if text is None:
            return None
        stack: list[int] = []
        mate, parent, depth = {}, {}, {}
        for i, c in enumerate(text):
            if c == "(":
                parent[i], depth[i] = stack[-1] if stack else None, len(stack)
                stack.append(i)
            elif c == ")" and stack:
                mate[stack.pop()] = i
        return [{"place": i, "mate": mate[i], "parent": parent[i], "depth": depth[i], "size": (mate[i] - i + 1) // 2} for i in sorted(mate)]

    return column.map(of)


def parentheses(text: Column) -> Column:
    """Of every closed opening parenthesis: its place, its mate, the one around it, its depth and its subtree's size."""
    return F.pandas_udf(_parentheses, "array<struct<place:long,mate:long,parent:long,depth:long,size:long>>")(text)


@dataclass(frozen=True)
class WordSet:
    """A sorted set of words with their ranks; small enough for the driver, so it is a constant of a plan."""

    words: tuple[str, ...]

    @classmethod
    def of(cls, words: list[str]) -> WordSet:
        return cls(tuple(sorted(set(words), key=lambda w: w.encode())))

    def contains(self, word: Column) -> Column:
        return word.isin(*self.words) if self.words else F.lit(False)

    def rank(self, word: Column) -> Column:
        """The word's place in the set, null if it is not in it."""
        return F.when(self.contains(word), F.array_position(F.array(*[F.lit(w) for w in self.words]), word) - 1) if self.words else F.lit(None).cast("long")

    def spell(self, place: int) -> str:
        return self.words[place]

    def with_prefix(self, prefix: str) -> tuple[str, ...]:
        keys = [w.encode() for w in self.words]
        low = bisect.bisect_left(keys, prefix.encode())
        high = low
        while high < len(keys) and keys[high].startswith(prefix.encode()):
            high += 1
        return self.words[low:high]
