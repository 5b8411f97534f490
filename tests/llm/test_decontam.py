import hashlib
import random
import re

from glyphlake.llm import decontam

from . import cases

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, body in items:
            b = split(body)
            for i in range(max(1, len(b) - window + 1) if b else 0):
                p = b[i : i + window]
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit |= set(range(k, k + len(p)))
                        if item is not None:
                            found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_and_docs(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "aß", "x1"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 6]))) for i in range(6)] + [(6, None), (7, ""), (8, "..."), (3, text(3))]
    docs = [(r[0], r[1]) for r in cases.rows() if r[0] != 24] + [(100 + i, text(rng.randint(0, 40))) for i in range(40)]
    return items, docs


def test_hits_are_those_of_brute_force(spark):
    for seed in range(3):
        items, docs = items_and_docs(seed)
        got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=4)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 4)


def test_benchmark_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "QUERY_BYTES", 8)
    items, docs = items_and_docs(5)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontam.contamination(frame, bench, window=4).collect()), key=repr) == brute(docs, items, 4)


def test_small_blocks(spark, monkeypatch):
    items, docs = items_and_docs(7)
    block = decontam.Block.build([d.encode() if d is not None else None for _, d in docs])
    which, begin = block.lookup(decontam.Phrases([(str(i), t.encode() if t else None) for i, t in items], 4))
    assert len(which) == len(begin) > 0


def test_dropping_and_empty_tables(spark):
    items, docs = items_and_docs(1)
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, source string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in decontam.drop_contaminated(frame, bench, window=4).collect()), key=repr)
    clean = {repr((b[0], b[1])) for b in brute(docs, items, 4) if not b[5]}
    assert kept and all(repr((i, len(split(t)))) in clean for i, t in kept) and len(kept) == sum(not b[5] for b in brute(docs, items, 4))
    assert decontam.contamination(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontam.contamination(frame, bench.limit(0)).collect())


def test_postings_are_stored_and_read_back(spark, tmp_path):
    items, docs = items_and_docs(2)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    decontam.build_index(frame.repartition(4)).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    found = {(r.doc_id, r.n_words, sum(s.last - s.first + 1 for s in r.spans)) for r in decontam.search(stored, bench, window=4).collect()}
    assert found == {b[:3] for b in brute(docs, items, 4)}
    assert spark.read.schema(stored.schema).parquet(*decontam.stored_index(frame).inputFiles()).count() >= 1


def test_columns_may_have_any_names(spark):
    items, docs = items_and_docs(3)
    rows = [(*d, 1, "x", [1], "y", None) for d in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id int, terms string, starts array<int>, items string, spans int")
    got = decontam.contamination(frame, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as doc_id", "1 as spans"), window=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 4)


def near_by_brute(docs, items, slop, window):
    """Each place of a phrase's first word, followed by the next place of each further word."""
    out = []
    for doc_id, text in docs:
        w = split(text)
        for item, body in items:
            phrase = split(body)[:window]
            for k in range(len(w)) if phrase else ():
                at = k if w[k] == phrase[0] else None
                for p in phrase[1:]:
                    at = None if at is None else next((j for j in range(at + 1, len(w)) if w[j] == p), None)
                if at is not None and at - k + 1 - len(phrase) <= slop:
                    out.append((doc_id, item, k, at))
    return sorted(out, key=repr)


def test_proximity(spark):
    docs = [(1, "red small fox"), (2, "red fox"), (3, "fox red"), (4, "red a b c d fox"), (5, None)]
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = decontam.search_near(index, spark.createDataFrame([(9, "Red fox")], "item_id long, text string"), slop=2).collect()
    assert sorted(tuple(r) for r in found) == [(1, 9, 0, 2), (2, 9, 0, 1)]
    items, docs = items_and_docs(4)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.search_near(decontam.stored_index(frame), bench, slop=3, window=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_by_brute(docs, items, 3, 4)
