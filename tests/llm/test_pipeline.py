import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from glyphlake.llm import decontam, mixing, quality  # noqa: E402

from . import cases  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmarks", "mix", "shards"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    want = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want
    one = stages["near_copies"](spark, good, SF).cache()
    assert one.columns == columns and one.groupBy("text").count().where("count > 1").isEmpty()
    clean = stages["benchmarks"](spark, one, SF).cache()
    hit = {r.doc_id for r in decontam.contamination(one, bench).where("contaminated").collect()}
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == hit
    mixed = stages["mix"](spark, clean, SF).cache()
    plan = mixing.plan_mix(clean).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    got = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    assert mixed.columns == columns and all((got.get(r.source) or 0) == r.n for r in plan)
    final = stages["shards"](spark, mixed, SF)
    assert final.columns == [*columns, "shard", "slot"] and final.count() == mixed.count()


@pytest.mark.parametrize("stage", ["quality", "near_copies", "benchmarks"])
def test_rows_go_to_python_workers_in_batches_of_bounded_bytes(spark, stage):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for said, most in ((None, 4 << 20), ("1m", 1 << 20)):
        session = spark.newSession()
        if said:
            session.conf.set(key, said)
        dict(corpus_pipeline.STAGES)[stage](session, session.read.parquet(f"{SF}/documents.parquet"), SF)
        texts = session.range(1200).coalesce(1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

        found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 12_000_000 and max(found) <= most + 20_000


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_take_awkward_rows_and_any_columns(spark, tmp_path):
    docs = cases.frame(spark).withColumns({"label": F.lit(1), "node": F.lit("x"), "y": F.lit(2), "__h": F.lit(3), "__own": F.lit(4), "m": F.create_map(F.lit("k"), F.lit(1))})
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns[: len(docs.columns)] == docs.columns
        assert (out.columns == docs.columns) == (name != "shards")
        found = out.groupBy("doc_id", "text").count().collect()
        assert len(found) <= docs.select("doc_id", "text").distinct().count() + docs.select("source").distinct().count()
        if name == "near_copies":
            assert {r.doc_id for r in found} == {None, *range(13), 17, 18, 21, 22, 23, 24} - {17} and sum(r["count"] for r in found if r.doc_id is not None) == len([r for r in found if r.doc_id is not None])
        if name == "benchmarks":
            assert out.count() == rows - docs.where("text = 'two words'").count()
        if name == "shards":
            assert out.count() == rows and out.select("shard", "slot").distinct().count() == rows
