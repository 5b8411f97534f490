import random
import re

import pytest
from pyspark.sql import functions as F

from glyphlake.corpus import Corpus, line_grid, split_lines
from glyphlake.functions.patterns import Pattern
from glyphlake.operators import search
from glyphlake.sources import sinks

TEXTS = ["", "\n", "a", "a\n", "\na", "a\n\nb", "ab ab\ncd\nab", "é ab\nxab y\n", "one\r\ntwo ab\r\n", None, "cd\ncd\nab\ncd\ncd\ncd\ncd\nab\n"]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.from_rows(spark, [(i, f"f{i}", t) for i, t in enumerate(TEXTS)])


def lines_of(text):
    parts = (text or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def test_lines_and_their_offsets(corpus):
    got = line_grid(corpus.lines()).collect()
    want = []
    for i, t in enumerate(TEXTS):
        at = 0
        for n, line in enumerate(lines_of(t), 1):
            size = len(line.encode())
            want.append((i, n, line, at, at + size, at + size + 1))
            at += size + 1
    assert sorted((r.doc_id, r.line_number, r.line, r.start, r.content_end, r.term_end) for r in got) == want
    assert {r.line for r in corpus.lines(crlf=True).where("doc_id = 8").collect()} == {"one", "two ab"}


def test_modes(corpus):
    ab = Pattern("ab")
    per = {f"f{i}": [n for n, x in enumerate(lines_of(t), 1) if "ab" in x] for i, t in enumerate(TEXTS)}
    assert {r.path for r in search.files_with_matches(corpus, ab).collect()} == {p for p, n in per.items() if n}
    assert {r.path for r in search.files_without_match(corpus, ab).collect()} == {p for p, n in per.items() if not n}
    assert {r.path: r.n for r in search.count_lines(corpus, ab, include_zero=True).collect()} == {p: len(n) for p, n in per.items()}
    assert {r.path: r.n for r in search.count_lines(corpus, ab, cap=1).collect()} == {p: 1 for p, n in per.items() if n}
    assert {r.path: r.n for r in search.count_matches(corpus, ab).collect()} == {f"f{i}": (t or "").count("ab") for i, t in enumerate(TEXTS) if "ab" in (t or "")}
    assert search.exists(corpus, ab) and not search.exists(corpus, Pattern("zz"))
    assert search.cap_per_file(search.matching_lines(corpus, ab), 0).collect() == []


def test_an_empty_document_never_matches(corpus):
    assert "f0" not in {r.path for r in search.files_with_matches(corpus, Pattern("x*")).collect()}
    assert "f1" in {r.path for r in search.files_with_matches(corpus, Pattern("x*")).collect()}


def test_context_bands(corpus):
    got = search.with_context(corpus.lines().where("doc_id = 10"), F.contains("line", F.lit("ab")), before=1, after=2).orderBy("line_number").collect()
    assert [(r.line_number, r.kind, r.band) for r in got] == [(2, "context", 1), (3, "match", 1), (4, "context", 1), (5, "context", 1), (7, "context", 2), (8, "match", 2)]


def test_stop_on_nonmatch(corpus):
    got = search.stop_on_nonmatch(corpus.lines(), F.contains("line", F.lit("cd"))).collect()
    assert sorted((r.doc_id, r.line_number) for r in got) == [(6, 2), (10, 1), (10, 2)]


def test_positions_captures_replacement(corpus):
    p = Pattern("(x?)(ab)")
    rows = search.with_position(search.matching_lines(corpus, p), p).where("doc_id = 7").orderBy("line_number").collect()
    assert [(r.line_number, r.column) for r in rows] == [(1, 4), (2, 1)]
    caught = search.captures(corpus.lines(), p, {"x": 1, "y": 2}).where("doc_id = 7").orderBy("line_number").collect()
    assert [(r.x, r.y) for r in caught] == [("", "ab"), ("x", "ab")]
    swapped = search.replace_matches(corpus.lines(), p, "<$2$1>", ("", "")).where("doc_id = 7").orderBy("line_number").collect()
    assert [r.line for r in swapped] == ["é <ab>", "<abx> y"]


def test_multiline(corpus):
    assert {r.path for r in search.multiline_docs(corpus, Pattern("ab\ncd")).collect()} == {"f6", "f10"}
    touched = sorted((r.path, r.line_number) for r in search.multiline_lines(corpus, Pattern("ab\ncd")).collect())
    assert touched == [("f10", 3), ("f10", 4), ("f6", 1), ("f6", 2)]


def test_only_matching_and_vimgrep_like_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1é \n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    corpus = Corpus.from_rows(spark, [(i, f"f{i}", t) for i, t in enumerate(texts)])
    p = Pattern("a+b|[0-9]")
    got = sorted((r.doc_id, r.line_number, r.ordinal, r.match) for r in search.only_matching(corpus.lines(), p).collect())
    want = [(i, n, k, m[0]) for i, t in enumerate(texts) for n, x in enumerate(lines_of(t), 1) for k, m in enumerate(re.finditer("a+b|[0-9]", x), 1)]
    assert got == want
    rows = sorted(r.value for r in sinks.vimgrep(corpus, p).collect())
    assert rows == sorted(f"f{i}:{n}:{len(x[: m.start()].encode()) + 1}:{x}" for i, t in enumerate(texts) for n, x in enumerate(lines_of(t), 1) for m in re.finditer("a+b|[0-9]", x))


def test_snippets_and_previews(spark):
    df = spark.createDataFrame([("  " + "x" * 200 + "needle" + "y" * 200,), ("a needle",)], "line string")
    got = [r[0] for r in df.select(search.snippet(F.col("line"), Pattern("needle"))).collect()]
    assert got[0].startswith("…") and got[0].endswith("…") and "needle" in got[0] and len(got[0]) == 122 and got[1] == "a needle"
    cut = [r[0] for r in df.select(search.trimmed(F.col("line"), 10)).collect()]
    assert cut == ["[Omitted long matching line]", "a needle"]


def test_records_and_json(spark, corpus):
    nul = Corpus.from_rows(spark, [(1, "f", "a\nb\0c\0")])
    assert [r.line for r in search.records(nul, "\0", Pattern("[abc]")).orderBy("line_number").collect()] == ["a\nb", "c"]
    kinds = [r.k for r in sinks.json_records(corpus, Pattern("ab")).where("path = 'f6'").orderBy("ordinal").select(F.get_json_object("record", "$.type").alias("k")).collect()]
    assert kinds == ["begin", "match", "match", "end"]


def test_members(spark):
    rows = [(1, "a", "x"), (2, "b", ""), (3, "c", "x\0y"), (4, "d", "x" * 9000 + "\0"), (5, "e", None)]
    assert sorted(r.doc_id for r in Corpus.from_rows(spark, rows).members().df.collect()) == [1, 4]
    assert split_lines(Corpus.from_rows(spark, rows).df, "\n").where("doc_id in (2, 5)").collect() == []


def test_manifest_does_not_depend_on_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert sinks.manifest(df).first() == sinks.manifest(df.repartition(7)).first() != sinks.manifest(df.where("id > 0")).first()


def test_json_has_context_spans_and_a_summary(spark):
    import json

    small = Corpus.from_rows(spark, [(1, "a", "é x\nnone\nab éab\nlast"), (2, "b", "nothing")])
    rows = [json.loads(r.record) for r in sinks.json_records(small, Pattern("ab"), before=1).orderBy(F.col("path").asc_nulls_last(), "ordinal").collect()]
    assert [r["type"] for r in rows] == ["begin", "context", "match", "end", "summary"]
    data = rows[2]["data"]
    assert data["absolute_offset"] == 10 and data["lines"]["text"] == "ab éab\n" and [(m["match"]["text"], m["start"], m["end"]) for m in data["submatches"]] == [("ab", 0, 2), ("ab", 5, 7)]
    assert rows[1]["data"]["submatches"] == [] and rows[3]["data"]["stats"] == {"matched_lines": 1, "matches": 2} and rows[4]["data"]["stats"]["searches_with_match"] == 1
