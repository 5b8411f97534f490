import zlib
from collections import Counter

from pyspark.sql import functions as F

from glyphlake.llm import sharding

from . import cases


def check(rows, n, shards):
    assert len(rows) == n
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_counts_slots_and_columns(spark):
    rows = cases.rows()
    got = sharding.shard(cases.frame(spark), shards=5).collect()
    check(got, len(rows), 5)
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want


def test_linked_documents_move_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(300)] + [(1000 + i, f"single {i}") for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check(got, 1200, 8)
    where = {}
    for r in got:
        if r.doc_id < 1000:
            where.setdefault(r.doc_id // 3, set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 3


def test_a_group_larger_than_a_shard_fills_as_few_as_it_can(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_GROUP", 40)
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"single {i}") for i in range(800)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    check(got, 1200, 10)
    assert len({r.shard for r in got if r.doc_id < 1000}) <= 5


def test_quotas_hold_without_free_documents(spark):
    rows = [(i, f"text {i // 4}") for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, shards=6).collect()
    check(got, 203, 6)
    again = sharding.shard(df.repartition(5), shards=6).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_fewer_documents_than_shards_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    check(sharding.shard(df, shards=40).collect(), 3, 40)
    assert sharding.shard(cases.empty(spark), shards=4).collect() == []


def test_documents_with_their_shards(spark):
    df = cases.frame(spark)
    got = sharding.shard_documents(df, shards=3)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert got.drop("shard", "slot").exceptAll(df).isEmpty() and got.count() == df.count()
    assert got.groupBy("shard", "slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    clash = sharding.shard_documents(df.withColumn("slot", F.lit("x")), shards=3)
    assert clash.columns == [*df.columns, "shard", "slot"] and dict(clash.dtypes)["slot"] == "bigint"
    assert "Python" not in got._jdf.queryExecution().toString()
