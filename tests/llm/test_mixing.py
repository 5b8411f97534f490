import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import mixing

from . import cases


def plan_rows(df):
    return sorted((tuple(r) for r in mixing.plan_mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def test_plan_is_that_of_the_sql(spark):
    rows = cases.rows()
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted((tuple(r) for r in con.sql(mixing.oracle_sql()).fetchall()), key=repr)
    assert plan_rows(cases.frame(spark)) == want


def test_targets_and_bounds(spark):
    df = cases.frame(spark)
    plan = mixing.plan_mix(df).toPandas()
    assert (plan.taken <= 2 * plan["size"]).all()
    per = plan.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "max"), size=("source_size", "max"))
    assert (abs(per.taken - per.target) <= 0.5).all() and (per.target <= 2 * per["size"]).all()
    assert per.target.sum() == pytest.approx(1.5 * per["size"].sum())
    assert plan_rows(df) == plan_rows(df.repartition(7))


def test_mixed_rows_have_the_planned_words(spark):
    df = cases.frame(spark)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    want = mixing.plan_mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert all(abs((got.get(r.source) or 0) - r.n) <= 3 for r in want)
    whole = {r[1] for r in cases.rows()}
    assert sum(r.text not in whole for r in mixed.collect()) <= 4


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\nc d ", k) for k in range(6)], "text string, k int").select(mixing.first_words(F.col("text"), F.col("k")).alias("x"))
    assert [r.x for r in df.collect()] == ["", " a", " a  b", " a  b\nc", " a  b\nc d", " a  b\nc d"]


def test_water_filling_with_few_and_many_sources(spark):
    assert mixing.plan_mix(cases.empty(spark)).collect() == []
    for sizes in ([100], [1000, 1], [1, 1000, 10, 500, 3], [0, 0]):
        rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
        got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).orderBy("source").collect()
        level = brute_level(sizes)
        assert [r.target for r in got] == pytest.approx(level)


def brute_level(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    budget, clamped = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        rest = budget - sum(2 * sizes[i] for i in clamped)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in clamped else share[i] for i in range(len(sizes))]
        clamped |= over


def test_no_python_runs_in_the_plan(spark):
    text = mixing.mix(cases.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and os.sep


def test_targets_of_sizes_whose_products_are_beyond_longs(spark):
    sizes = [(f"s{k:02d}", 10**16 + k) for k in range(30)]
    got = mixing.source_targets(spark.createDataFrame(sizes, "source string, size long"), (5, 2, 1), 150, 2).collect()
    assert sum(r.target for r in got) == pytest.approx(1.5 * sum(n for _, n in sizes)) and all(r.target <= 2 * r.source_size * (1 + 1e-12) for r in got)
