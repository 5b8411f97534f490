"""Posting lists as bytes: differences of ascending numbers, seven bits a byte, the lowest first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(numbers: np.ndarray) -> bytes:
    """Ascending distinct numbers from 0."""
    numbers = np.asarray(numbers, np.int64)
    if len(numbers) and (numbers[0] < 0 or (np.diff(numbers) <= 0).any()):
        raise ValueError("postings ascend from 0 on, each once")
    gaps = np.diff(numbers, prepend=0).astype(np.uint64)
    groups = np.maximum(1, sum((gaps >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(9)))
    out = np.zeros(int(groups.sum()), np.uint8)
    ends = np.cumsum(groups)
    for k in range(int(groups.max(initial=0))):
        some = groups > k
        at = (ends - groups + k)[some]
        out[at] = (gaps[some] >> np.uint64(7 * k)).astype(np.uint64) & np.uint64(127)
        out[at] |= np.where(groups[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def decode(packed: bytes, most: int | None = None) -> np.ndarray:
    """What encode() was given; bytes that it would not have written, or a number above `most`, are an error."""
    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
        raise ValueError("the last number is cut")
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    sizes = ends - starts + 1
    if len(sizes) and (sizes.max() > 9 or ((raw[ends] == 0) & (sizes > 1)).any()):
        raise ValueError("a number is longer than it needs to be")
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    gaps = np.add.reduceat((raw.astype(np.int64) & 127) << (7 * place), starts) if len(starts) else np.zeros(0, np.int64)
    numbers = np.cumsum(gaps)
    if (gaps[1:] == 0).any() or (most is not None and len(numbers) and numbers[-1] > most):
        raise ValueError("a number comes twice or is too large")
    return numbers


@F.pandas_udf(T.BinaryType())
def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ascending longs as bytes."""
    for column in batches:
        yield column.map(lambda x: None if x is None else encode(x))


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in batches:
        yield column.map(lambda x: None if x is None else decode(bytes(x)))
