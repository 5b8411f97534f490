import random

from pyspark.sql import functions as F

from glyphlake.corpus import Corpus
from glyphlake.functions import paths, succinct
from glyphlake.functions.patterns import Pattern
from glyphlake.operators import indexes, search
from glyphlake.sources import sinks


def test_bits(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(63), rng.randint(0, 64), rng.randint(0, 40)) for _ in range(60)]
    df = spark.createDataFrame(rows, "b long, p int, k int")
    for (b, p, k), r in zip(rows, df.select(succinct.popcount(F.col("b")).alias("n"), succinct.rank(F.col("b"), F.col("p")).alias("r"), succinct.select(F.col("b"), F.col("k")).alias("s")).collect(), strict=True):
        ones = [i for i in range(64) if b >> i & 1]
        assert (r.n, r.r, r.s) == (len(ones), sum(i < p for i in ones), ones[k] if k < len(ones) else None)
    assert spark.range(1).select(succinct.mask_of(F.array(F.lit(0), F.lit(3)))).first()[0] == 9


def test_parentheses(spark):
    df = spark.createDataFrame([("(()(()))(",), (None,)], "t string")
    got = df.select(succinct.parentheses(F.col("t")).alias("p")).collect()
    assert [(x.place, x.mate, x.parent, x.depth, x.size) for x in got[0].p] == [(0, 7, None, 0, 4), (1, 2, 0, 1, 1), (3, 6, 0, 1, 2), (4, 5, 3, 2, 1)]
    assert got[1].p is None


def test_word_sets(spark):
    words = succinct.WordSet.of(["b", "ab", "a", "é", "b"])
    df = spark.createDataFrame([("a",), ("b",), ("é",), ("z",)], "w string")
    assert [r[0] for r in df.select(words.rank(F.col("w"))).collect()] == [0, 2, 3, None]
    assert words.spell(1) == "ab" and words.with_prefix("a") == ("a", "ab") and words.with_prefix("q") == ()


def test_headed_output_and_paths(spark):
    corpus = Corpus.from_rows(spark, [(1, "f", "a\nhit\nb\nc\nd\nhit\n")])
    rows = sinks.headed(search.with_context(corpus.lines(), F.contains("line", F.lit("hit")), 1, 0), context=True).orderBy("ordinal").collect()
    assert [r.value for r in rows] == ["f", "1-a", "2:hit", "--", "5-d", "6:hit"]
    assert sinks.null_separated(corpus.lines()).first().value == "f\x001:a"
    df = spark.createDataFrame([("./a", "x"), ("", "x"), ("a/", "/x"), ("b//", "x")], "f string, n string")
    assert [r[0] for r in df.select(paths.join_path(paths.strip_dot(F.col("f")), F.col("n"))).collect()] == ["a/x", "x", "/x", "b/x"]
    files = spark.createDataFrame([("a-b", 2), ("a/b", 2), ("c", 1)], "path string, mtime int")
    assert [r.path for r in paths.sort_files(files).collect()] == ["a/b", "a-b", "c"]
    assert [r.path for r in paths.sort_files(files, "modified", reverse=True).collect()] == ["a-b", "a/b", "c"]


def test_witness_and_clause_order(spark):
    corpus = Corpus.from_rows(spark, [(1, "in/a", "none"), (2, "out/b", "needle"), (3, "out/a", "needle")])
    inside = paths.under_root(F.col("path"), "in")
    assert [r.path for r in search.witness(corpus, inside, Pattern("needle")).collect()] == ["out/a"]
    assert search.witness(corpus, inside, Pattern("zzz")).collect() == []
    rows = indexes.postings(corpus.df)
    assert indexes.cheapest_first(rows, [[["nee", "eed"]], [["non"]], [["zzz"]]]) == [[["zzz"]], [["non"]], [["nee", "eed"]]]


def test_old_generations_go(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    for g in "123":
        indexes.persist_generation(spark, docs, str(tmp_path), g)
    assert indexes.reclaim(spark, str(tmp_path), keep=1) == ["generation-1", "generation-2"]
    assert indexes.current_generation(spark, str(tmp_path)).count() == 2
