"""Rows made of texts in Python, in batches of bounded size on the way in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..storage import bound_batches

#: Rows that a Python worker holds before it hands them on.
ROWS = 1 << 16


def exploded(df: DataFrame, keep: tuple[str, ...], text: str, fields: str, made: Callable[[], Callable[[str | None], Iterable[tuple]]]) -> DataFrame:
    """(keep..., fields...): a row for each tuple that a function gives for a text; made() is called once a task and returns it."""
    bound_batches(df.sparkSession)
    own = StructType.fromDDL(fields)
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    kept, types = list(keep), {f.name: kinds[f.dataType.simpleString()] for f in own}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return unrolled(batches, kept, types, made())

    return df.select(*keep, text).mapInArrow(run, StructType([*df.select(*keep).schema, *own]))


def unrolled(batches: Iterable[pa.RecordBatch], keep: list[str], types: dict[str, pa.DataType], of: Callable[[str | None], Iterable[tuple]], most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of the first columns and a text behind them become batches of those columns and what the function gives.

    Tuples are taken as they are needed and at most `most` are held, however many a text gives."""

    def packed(batch: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        own = pa.array(owners, pa.int32())
        columns = [batch.column(k).take(own) for k in range(len(keep))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=[*keep, *types])

    for batch in batches:
        owners: list[int] = []
        rows: list[tuple] = []
        for k, value in enumerate(batch.column(len(keep))):
            left = iter(of(value.as_py()))
            while True:
                before = len(rows)
                rows.extend(islice(left, most - before))
                owners.extend([k] * (len(rows) - before))
                if len(rows) < most:
                    break
                yield packed(batch, owners, rows)
                owners, rows = [], []
        if rows:
            yield packed(batch, owners, rows)
