"""From raw documents to shards: quality, near copies, benchmark passages, source mix, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import decontam, mixing, quality, sharding, simhash
from glyphlake.llm.common import bound_batches, materialize, release, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  Null and empty texts score alike; repeated rows share their fate;
    an empty table stays empty, and without labels of both kinds all documents stay."""
    bound_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, all such pairs.

    Found by SimHash anchors and verified by whole sets; what anchors leave apart is joined exactly.  Null and empty
    texts are one group, rows without an id all stay, of repeated rows one stays."""
    bound_batches(spark)
    return simhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item, or a whole shorter item.  Null and empty texts
    stay; repeated rows are judged alike; without items all stay."""
    bound_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.  A null source is one of its own, null
    texts have no words, repeated rows count by themselves."""
    return mixing.mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it; every row is placed, null and repeated ones as well."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("benchmarks", without_benchmarks),
    ("mix", mixed_sources),
    ("shards", into_shards),
]

#: Trained and hashed stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is deleted as soon as it has been read."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            release(written)
        written = docs
    return docs
