import random

import numpy as np
import pytest

from glyphlake.llm import copies, simhash


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    x, y = grams(a), grams(b)
    return not x | y or len(x & y) / len(x | y) >= 0.8


def brute(rows):
    root = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if root[i] != root[j] and alike(a, b):
                root = [root[j] if r == root[i] else r for r in root]
    return {rows[i][0]: min(k for (k, _), r in zip(rows, root, strict=True) if r == root[i]) for i in range(len(rows))}


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_isolated_pairs_at_and_above_the_threshold_are_all_found(spark):
    rng, rows, near = random.Random(3), [], 0
    for k in range(150):
        text = words(rng, rng.choice([30, 60, 100, 200, 400]))
        other = list(text)
        for _ in range(max(1, len(text) // 50) + k % 2):
            other[rng.randrange(len(other))] = "changed"
        near += alike(" ".join(text), " ".join(other))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    nine = words(rng, 12)  # 8 shingles; 2 more of the copy make exactly 0.8
    rows += [(1000, " ".join(nine)), (1001, " ".join([*nine, "x", "y"])), (1002, " ".join([*nine, "x", "y", "z"])), (1003, ""), (1004, " ")]
    assert 60 < near < 150
    got = {r.doc_id: r.component_id for r in copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[1001] == 1000
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(got.values())


@pytest.mark.parametrize("chunk", [8, 4096])
def test_groups_with_a_common_passage(spark, chunk):
    rng = random.Random(5)
    passage, base, rows = words(rng, 25), words(rng, 80), []
    for k in range(120):
        text = [*passage, *words(rng, rng.choice([2, 8, 20]))] if k % 2 else list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(9)}"
        rows.append((k, " ".join(text)))
    got = {r.doc_id: r.component_id for r in copies.groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()}
    assert got == brute(rows)


def test_a_first_passage_that_most_share_is_dealt_over_tasks(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(copies, "SPOKES", 4)
    base, rows = words(rng, 40), []
    for k in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(5)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert max(copies.common_shingles(docs, 5, "text", 8)[2]) > 4
    assert {r.doc_id: r.component_id for r in copies.groups(docs, chunk=8).collect()} == brute(rows)


def test_parity_bits_never_differ_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n in (5, 100, 700, 3000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate([a[: n * 4 // 5], rng.integers(-(2**63), 2**63 - 1, n // 5)]))
        c = np.unique(rng.integers(-(2**63), 2**63 - 1, n * 9 // 8))
        x, y, z = map(copies.parity, (a, b, c))
        assert copies.apart(x, y) <= len(set(a.tolist()) ^ set(b.tolist()))
        assert n < 100 or copies.apart(x, z) > copies.most_apart(len(a) + len(c), 0.8)
        rows = [x, y, z, copies.folded(x, 1024).tobytes()]
        assert copies._differ(rows, np.array([0, 0, 2, 1]), np.array([1, 2, 0, 3])).tolist() == [copies.apart(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (2, 0), (1, 3))]
        assert (copies.folded(x, 1024) == np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, 16), axis=0)).all()


def test_groups_that_go_over_many_batches(spark):
    rng = random.Random(9)
    passage, rows = words(rng, 25), []
    for k in range(90):
        text = [*passage, *words(rng, rng.choice([2, 8, 20]))]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(9)}"
        rows.append((k, " ".join(text)))
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1k")
    docs = session.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in copies.groups(docs, chunk=16).collect()} == brute(rows)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(brute(rows).values())
