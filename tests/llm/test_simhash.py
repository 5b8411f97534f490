import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from glyphlake.llm import simhash

from . import cases


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids_and_fps, distance):
    labels = list(range(len(ids_and_fps)))

    def root(x):
        while labels[x] != x:
            x = labels[x]
        return x

    for i, (_, a) in enumerate(ids_and_fps):
        for j, (_, b) in enumerate(ids_and_fps[:i]):
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                labels[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (key, _) in enumerate(ids_and_fps):
        if key is not None:
            best[root(i)] = min(best.get(root(i), key), key)
    return [best.get(root(i)) for i in range(len(ids_and_fps))]


def test_fingerprints_of_all_rows(spark):
    rows = cases.rows()
    got = simhash.near_duplicates(cases.frame(spark)).collect()
    want = [(r[0], plain_fingerprint(r[1])) for r in rows]
    named = [(i, fp, c) for (i, fp), c in zip(want, brute_components(want, 3), strict=True)]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == sorted(named, key=repr)


def test_links_of_close_fingerprints_are_complete(spark):
    rng = random.Random(2)
    fps = [0, 2**64 - 1]
    for _ in range(60):
        base = rng.getrandbits(64)
        fps += [base]
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(fps[-3:])
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.append(x)
    table = [(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)]
    got = simhash.group_by_fingerprint(spark.createDataFrame(table, "doc_id long, fp long")).collect()
    want = brute_components(list(enumerate(fps)), 3)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_every_half_has_one_home_and_its_neighbours(spark):
    rng = random.Random(4)
    rows = [(int(np.uint64(rng.getrandbits(64)).view(np.int64)),) for _ in range(50)]
    nodes = spark.createDataFrame(rows, "node long")
    per = simhash.anchors(nodes).groupBy("node").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("n"), F.countDistinct("anchor").alias("d")).collect()
    assert all(r.homes == 2 and r.n == r.d and r.n in (2, 17, 32) for r in per)


def test_chunks_give_the_same_groups(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 7)})
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "node long")
    labels = [{r.label for r in simhash.components(simhash.links(nodes, chunk=c)).collect()} for c in (16, 4096)]
    assert labels[0] == labels[1] and len(labels[0]) == 1


def test_one_of_each_group_stays(spark):
    rows = cases.rows()
    kept = simhash.keep_one(cases.frame(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert sum(i is None for i in ids) == sum(r[0] is None for r in rows)
    assert {12} <= set(ids) and not {13, 14, 15, 16} & set(ids)
    assert set(range(12)) <= set(ids)
    assert list(kept[0].asDict()) == cases.frame(spark).columns
    assert simhash.keep_one(cases.empty(spark)).collect() == []


def test_rows_that_share_an_id_count_by_themselves(spark):
    rng = random.Random(9)
    a, b, c = (cases.words(rng, 40) for _ in range(3))
    rows = [(5, a, {"x": 1}), (5, b, {"x": 2}), (7, c, {"x": 3}), (7, c, {"x": 1}), (8, c + " tail", {"x": 5}), (None, a, {"x": 6}), (None, None, None), (9, None, None), (10, "", None)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")).collect()
    assert sorted(((r.doc_id, r.text, (r.m or {}).get("x")) for r in got), key=repr) == sorted([(5, a, 1), (5, b, 2), (7, c, 1), (None, a, 6), (None, None, None), (9, None, None)], key=repr)
