"""Shared helpers of the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import bound_batches, materialize, ship  # noqa: F401  used by the operators

#: Characters that separate words where a contract says `[^\x20\x09-\x0D]+`.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Bytes A-Z to a-z, all others unchanged.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_rank(df: DataFrame, group: list[str], spread: Column, order: list[Column], out: str, parts: int = 64) -> DataFrame:
    """Gapless rank from 0 inside each group, without putting a whole group into one task.

    Rows of a group are dealt to `parts` sub-groups by `spread` and ranked there; the sub-groups'
    starts come from a running sum over their counts, of which a group has at most `parts`.
    """
    sub = "__sub"
    dealt = df.withColumn(sub, F.pmod(spread, F.lit(parts)).cast("int"))
    counts = dealt.groupBy(*group, sub).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)], F.col(sub).alias("__ks"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*[F.col(g) for g in group], F.col(sub)).orderBy(*order)
    ranked = dealt.withColumn("__rn", F.row_number().over(inner).cast("long") - 1)
    on = [F.col(g).eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(group)] + [F.col(sub) == F.col("__ks")]
    joined = ranked.join(starts, on, "left")
    return joined.withColumn(out, F.col("__start") + F.col("__rn")).drop(sub, "__ks", "__start", "__rn", *[f"__k{i}" for i in range(len(group))])


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def crc_fold(col: str, folds: int) -> Column:
    """crc32 of the column's text modulo folds; null stays null."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(folds))


def crc_fold_py(value: int, folds: int) -> int:
    return zlib.crc32(str(value).encode()) % folds
