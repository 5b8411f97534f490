import random

import numpy as np
import pytest

from glyphlake.functions import codecs, syntax
from glyphlake.operators import graphs, snapshots, substrings


def test_journals_replay_and_folders_tell_what_changed(spark, tmp_path):
    old = spark.createDataFrame([(1, "a/x", "one"), (2, "a/y", "two"), (3, "b/z", None), (None, "c", "?")], "doc_id long, path string, text string")
    new = spark.createDataFrame([(1, "a/x", "one"), (2, "a/y", "TWO"), (4, "b/w", "four")], "doc_id long, path string, text string")
    changes = snapshots.journal(old, new)
    assert sorted(tuple(r) for r in changes.collect()) == [(2, "update"), (3, "delete"), (4, "insert")]
    again = snapshots.replay(old.where("doc_id is not null"), changes, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, new.collect()))
    sized = lambda df: df.selectExpr("path", "length(text) as size", "xxhash64(text) as mtime")
    found = snapshots.changed_folders(snapshots.folders(sized(old)), snapshots.folders(sized(new)))
    assert sorted(r.folder for r in found.collect()) == ["", "a", "b"]
    snapshots.store_bodies(old.unionByName(new), str(tmp_path / "bodies"))
    asked = new.select("doc_id", snapshots.content_key(new.text).alias("digest"))
    assert {tuple(r) for r in snapshots.bodies_of(asked, spark.read.parquet(str(tmp_path / "bodies"))).select("doc_id", "text").collect()} == {(1, "one"), (2, "TWO"), (4, "four")}


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        numbers = np.unique(rng.integers(0, 2 ** int(rng.integers(3, 62)), n))
        assert (codecs.decode(codecs.encode(numbers)) == numbers).all()
    assert codecs.encode(np.array([0, 127, 255, 300 + 255])) == bytes([0, 127, 128, 1, 172, 2])
    for bad in (b"\x80", b"\x80\x00", b"\x01\x00"):
        with pytest.raises(ValueError):
            codecs.decode(bad)
    with pytest.raises(ValueError):
        codecs.decode(codecs.encode(np.array([9])), most=8)
    with pytest.raises(ValueError):
        codecs.encode(np.array([3, 3]))


def test_minterms_partition_all_characters():
    rng = random.Random(3)
    for _ in range(30):
        sets = [syntax.normal([(a, a + rng.randint(0, 30)) for a in rng.sample(range(200), rng.randint(0, 4))]) for _ in range(4)]
        parts = syntax.minterms(sets)
        assert sum(syntax.size(x) for _, x in parts) == syntax.LAST + 1 and len({m for m, _ in parts}) == len(parts)
        for c in range(240):
            mark = sum(1 << k for k, x in enumerate(sets) if any(a <= c <= b for a, b in x))
            assert [m for m, x in parts if any(a <= c <= b for a, b in x)] == [mark]


def test_backward_search_counts_overlaps():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("ab\U0001f389") for _ in range(rng.randint(0, 40)))
        codex = substrings.Codex(text)
        for needle in ("a", "ab", "aba", "bb", "\U0001f389a", "zz"):
            assert codex.count(needle) == sum(text.startswith(needle, i) for i in range(len(text)))


def test_refinement_is_the_coarsest(spark):
    rng = random.Random(7)
    for _ in range(3):
        n = 14
        labels = {i: rng.choice("xy") for i in range(n)}
        edges = {(rng.randrange(n), rng.choice("pq"), rng.randrange(n)) for _ in range(18)}
        block = dict(labels)
        while True:
            signs = {i: (block[i], frozenset((k, block[t]) for s, k, t in edges if s == i)) for i in range(n)}
            names = {s: min(i for i in range(n) if signs[i] == s) for s in signs.values()}
            new = {i: names[signs[i]] for i in range(n)}
            if len(set(new.values())) == len(set(block.values())):
                break
            block = new
        got = graphs.refine(spark.createDataFrame(list(labels.items()), "node long, label string"), spark.createDataFrame(list(edges), "src long, kind string, dst long"))
        assert {r.node: r.block for r in got.collect()} == new


def test_folds_refuse_cycles(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1)], "node long, value long")
    with pytest.raises(ValueError):
        graphs.fold(nodes, spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long"), lambda v: v, lambda a, b: a)
