"""What a query holds at once stays bounded, and its answers are those of the plain way."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from glyphlake import storage
from glyphlake.corpus import Corpus
from glyphlake.functions import matching, rowwise
from glyphlake.operators import allpairs, indexes, kinship, lexing, substrings
from glyphlake.plans import registry


def test_rows_of_a_text_leave_in_bounded_batches():
    taken = []

    def of(value):
        for k in range(len(value or "")):
            taken.append(k)
            yield k, value[k]

    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(["abc" * 30, None, "x"])], names=["id", "t"])
    got = rowwise.unrolled([batch], ["id"], {"at": pa.int64(), "c": pa.string()}, of, most=16)
    assert next(got).num_rows == 16 and len(taken) == 16  # no more than a batch is held
    rest = [row for b in got for row in b.to_pylist()]
    assert len(rest) == 75 and rest[-1] == {"id": 9, "at": 0, "c": "x"} and rest[-2] == {"id": 7, "at": 89, "c": "c"}


def test_one_expression_scans_as_all_rules_do():
    rules, rng = lexing.Rules(("[a-z]+", "[a-c]+[0-9]?", "[0-9]+", r"[0-9]+\.[0-9]+", "", "ab|abc|ab1")), random.Random(3)
    of = lexing.scanner(rules)
    for _ in range(300):
        text = "".join(rng.choice("abcz12. ?é") for _ in range(rng.randint(0, 40)))
        assert list(of(text)) == list(lexing.scan(rules.compiled(), text))
    grouped = lexing.Rules((r"(a)\1", "(?i:B)", "a"))
    assert list(lexing.scanner(grouped)("aaab")) == list(lexing.scan(grouped.compiled(), "aaab")) == [(0, 2, 0), (2, 3, 2), (3, 4, 1)]


def test_workers_get_a_few_megabytes_of_texts_at_once(spark, tmp_path):
    @F.pandas_udf("long")
    def together(column: pd.Series) -> pd.Series:
        return pd.Series([len(column)] * len(column))

    spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text"), F.lit("a").alias("lang"), F.lit("b").alias("source")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = registry.corpus(spark, str(tmp_path)).df
    assert docs.select(together("text").alias("n")).agg(F.max("n")).first()[0] <= 5


def test_near_sets_are_found_by_blocks_without_a_table_of_candidates(spark, monkeypatch):
    """Blocks and tiles of a few sets give what brute force gives, for sets that all share common elements."""
    rng, size = np.random.default_rng(6), 128
    common = rng.integers(0, 1 << 62, 150)
    sets = []
    for k in range(70):
        base = np.concatenate([rng.choice(common, 60, replace=False), rng.integers(0, 1 << 62, 5 if k % 9 == 0 else 90)])
        for _ in range(3):
            keep = rng.random(len(base)) > rng.choice([0.02, 0.1, 0.25])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 62, (~keep).sum())]))[:size])
    order = sorted(range(len(sets)), key=lambda k: sets[k][-1])

    def block(ids):
        table, n = allpairs._table([sets[k] for k in ids], size)
        return allpairs.Block(np.array(ids, np.int64).tobytes(), n.tobytes(), table.tobytes(), size)

    monkeypatch.setattr(allpairs, "TILE", 16)
    monkeypatch.setattr(allpairs, "STRIP", 5)
    for threshold in (0.0, 0.25, 0.5, 0.7):
        want = {}
        for i in range(len(sets)):
            for j in range(i):
                union = np.union1d(sets[i], sets[j])[:size]
                apart = 1.0 - np.isin(union, np.intersect1d(sets[i], sets[j])).sum() / len(union)
                if apart <= threshold:
                    want[j, i] = apart
        parts = [block(order[:90]), block(order[90:])]
        got = {}
        for x, y in ((0, 0), (0, 1), (1, 1)):
            for i, j, d in allpairs.near(parts[x], parts[y], x == y, threshold, size):
                got |= {(min(p), max(p)): v for *p, v in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)}
        assert got == want and (threshold == 0 or want)
    # what is written is the blocks: no table of pairs that share an element
    rows = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sets)], "id long, s array<long>")
    monkeypatch.setattr(allpairs, "BLOCK", 50)
    before = len(storage._written)
    assert {(min(r.i, r.j), max(r.i, r.j)): r.distance for r in allpairs.pairs(rows, 0.7, size).collect()} == want
    assert [p.rpartition("/")[2][:16] for _, p in storage._written[before:]] == ["glyphlake-blocks"]


def test_an_index_moves_lists_of_documents(spark, tmp_path):
    texts = ["abcabc", None, "ab", "", "bcaé\U0001f600x", "abc\n\n\n"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "abcd")], "doc_id long, text string")
    want = sorted((t[i : i + 3], d) for d, t in enumerate(texts) if t for i in range(len(t) - 2) if t.find(t[i : i + 3]) == i)
    assert sorted(tuple(r) for r in indexes.postings(docs).where("doc_id is not null").collect()) == want
    assert sorted(r.trigram for r in indexes.postings(docs).where("doc_id is null").collect()) == ["abc", "bcd"]
    indexes.build(docs.coalesce(1), f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    assert stored.count() == len({g for g, _ in want} | {"bcd"})  # a row a trigram and batch, not a row a posting
    assert indexes.unlisted(stored).count() == len(want) + 2
    grams, counts, which = indexes.trigrams_of(["xyz", "xyzx"])
    assert (grams, counts.tolist(), which.tolist()) == (["xyz", "yzx"], [2, 1], [0, 1, 1])


def test_suffixes_are_ordered_from_several_characters_on():
    rng = random.Random(2)
    for n in [0, 1, 2, *[rng.randint(3, 60) for _ in range(200)], 3000]:
        text = [rng.choice([1, 2, 70000][: rng.randint(1, 3)]) for _ in range(n)] if n < 3000 else [5] * n
        for tail in ([], [0]):
            codes = np.array(text + tail, np.int64)
            want = sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
            assert substrings.suffix_ranks(codes).tolist() == want
    codex = substrings.Codex("anananas")
    assert (codex.count("ana"), codex.count("x")) == (3, 0) and set(codex.places) == {ord(c) + 1 for c in "an"}  # only what is asked for


def test_properties_are_read_from_a_table(spark):
    texts = ["aÄБ٣7 Ω", "", None, "\U0001d400x"]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", matching.property_counts(["Lu", "Nd", "Greek"])("text").alias("n")).collect()
    assert [r.n for r in sorted(got)] == [[3, 2, 1], [0, 0, 0], None, [1, 0, 0]]


def test_a_ripple_writes_what_it_reaches_and_not_all_mentions(spark):
    rows = [(1, "a", "def alpha():\n  beta()\nalpha"), (2, "b", "def beta(): pass"), (3, "c", "alpha()"), (4, "d", "other words\n" * 500), (5, "e", "class alpha")]
    before = len(storage._written)
    got = kinship.ripple(Corpus.from_rows(spark, rows).lines(), "beta")
    assert {(r.path, r.via, r.hops) for r in got.collect()} == {("a", "beta", 1), ("c", "alpha", 2)}
    assert sum(spark.read.parquet(p).count() for _, p in storage._written[before:]) == 3  # a; alpha; c


def test_pieces_that_stand_in_a_text(spark):
    frame = spark.createDataFrame([(1, "xabcabcdy"), (2, None), (3, "\U0001f600abcd")], "id long, text string")
    got = frame.select("id", kinship.standing(["abca", "abcd", "zzzz"])("text").alias("p")).collect()
    assert [r.p for r in sorted(got)] == [["abca", "abcd"], [], ["abcd"]]


def test_what_a_line_defines_is_sought_once_a_line(spark):
    lines = Corpus.from_rows(spark, [(1, "a", "def alpha(beta) alpha beta\n\nclass Long type x of things"), (2, "b", None)]).lines()
    found = kinship.mentions(lines)
    assert sorted((r.line_number, r.symbol, r.defines) for r in found.collect()) == [(1, "alpha", True), (1, "beta", False), (1, "def", False), (3, "Long", True), (3, "class", False), (3, "things", False), (3, "type", False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and plan.index("Generate") < plan.index("regexp_extract_all")  # nothing is left to do for a word
