"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..corpus import Corpus
from ..storage import bound_batches, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DOCS = "docs AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') || '/' || doc_id || '.txt' AS path, text FROM documents)"
LINES = (
    DOCS
    + """, parts AS (SELECT doc_id, path, string_split(text, chr(10)) AS p FROM docs),
lines AS (SELECT doc_id, path, CAST(i AS BIGINT) AS line_number, p[i] AS line
          FROM parts, LATERAL (SELECT unnest(generate_series(1, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END)) AS i))"""
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_documents(table(spark, sf_dir, "documents"))
