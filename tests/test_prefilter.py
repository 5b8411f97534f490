import random
import re

import pytest

from glyphlake.functions import matching as M
from glyphlake.functions.patterns import Pattern
from glyphlake.operators import indexes
from glyphlake.plans import prefilter

PATTERNS = ["abc", "a[bc]a", "(ab|ca)+b", "a{3}", "(abc|cab)(a|b)?c", "a.*bca", "(?:ab){2,}c", "[ab]{3}", "^abc$", "a*", "(a|)bcab", "b+cab|cca", r"a\b", "(?i:AB)c", "(?=a)ab", "x{0,2}abca", "((a)b)c"]


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_facts_hold_for_every_match(pattern):
    found = prefilter.facts(pattern)
    for text in words(400, len(pattern)):
        for m in re.finditer(pattern, text):
            assert found.least <= len(m[0]) and (found.most is None or len(m[0]) <= found.most)
            assert found.exact is None or m[0] in found.exact
            assert all(any(x in m[0] for x in clause) for clause in found.clauses()), (pattern, m[0], found)
            assert not found.anchored_start or m.start() == 0
            assert not found.anchored_end or m.end() == len(text)


def test_plans_do_not_change_answers(spark):
    docs = spark.createDataFrame(list(enumerate(words(150, 3))), "doc_id long, text string").cache()
    rows = indexes.postings(docs).cache()
    with_runs = indexes.with_runs(docs, ["lower", "digit", "alpha", "hex", "word"]).cache()
    for text in PATTERNS[:13]:
        pattern = Pattern(text)
        off = {r.doc_id for r in prefilter.search(docs, pattern, planned=False).collect()}
        assert {r.doc_id for r in prefilter.search(docs, pattern, postings=rows).collect()} == off, text
        assert {r.doc_id for r in prefilter.search(with_runs, pattern, runs=True).collect()} == off, text


#: Pieces of the dialect, from which patterns are put together.
PIECES = [
    "the", "a", r"\<", r"\>", r"\b{start}", r"\b{end-half}", r"\b", "[[:punct:]]{3}", "[a[bc]]", "[a-z--[aeiou]]", "[a-f&&[^b]]", "[a-c~~[b-d]]", r"\[0-9]", r"\\d", r"\d", "[0-9]{2,}", "[^a-c]", ".", "x?", "(?:ab|c)+",
    "(?P<n>t)", r"\x41", r"\x{e9}", r"\.", "[]a]", "[^]a]", "[a-]", r"[\]x]", r"[\d_]+", "(?s:.)", "[[:^digit:]]", r"\p{Lu}", "(t|th)e?", "{", "}", "]", "a{2}", "^", "$", "(?-u:a)", "(?i:TH)", r"\Qa.b\E", "[[a]x]y",
]
TEXTS = [
    "the end", "x the", "bathe", "!!! ?", "...", "ax bx cx", "cx", "[0-9]", "[0-9]]]]]", "[11111", r"\ddddd", r"\d12345", "12 345 67890", "café é", "ABC Abc", "]]]]]", "bcdfg bcdfg", "a.b", "{start}the", "t-h-e", "", "aa\nthe\n",
    "abab c", "TH th", "x]y a]y ay", "٣٤٥٦٧", "xa-", "_9_9", "a{2}aa", "c d b a", "the the", "a]", "tthe", "Éa",
]


def grammar(n, seed=11):
    rng = random.Random(seed)
    single = PIECES + [r"\<the\>", r"\[0-9]{5}", r"\\d{5}", r"\d{5}", "[a-z--[aeiou]]{5}", "[a[bc]]x"]
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "+", "{2}", "*", "|" + rng.choice(PIECES)]) for _ in range(n)]
    return sorted({*single, *made})


def test_plans_do_not_change_answers_of_generated_patterns(spark):
    jvm = spark._jvm.java.util.regex.Pattern
    tried = []
    for text in grammar(700):
        try:
            jvm.compile(Pattern(text).java())
        except Exception:
            continue
        tried.append(text)
    assert len(tried) > 250
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    columns = []
    for text in tried:
        pattern = Pattern(text)
        found = pattern.matches(docs.text)
        kept = prefilter.guard(docs.text, prefilter.facts(text)) & indexes.survives(indexes.required_runs(text))
        columns.append((found & ~kept))
    runs = indexes.with_runs(docs).cache()
    lost = set()
    for k in range(0, len(columns), 100):
        for row in runs.select("text", *[c.alias(f"c{k + i}") for i, c in enumerate(columns[k : k + 100])]).collect():
            lost |= {(tried[int(c[1:])], row.text) for c, v in row.asDict().items() if c != "text" and v}
    assert not lost
    assert sum(bool(prefilter.facts(t).clauses()) for t in tried) > len(tried) / 4 and sum(bool(indexes.required_runs(t)) for t in tried) > len(tried) / 6


def test_known_runs():
    assert dict(indexes.required_runs("[0-9a-f]{12}")[0])["hex"] == 12
    assert dict(indexes.required_runs("[0-9]{2}(?:[0-9]x)+")[0])["digit"] == 3
    assert [dict(r).get("digit") for r in indexes.required_runs("[0-9]{2}|a[0-9]+")] == [2, 1]
    assert indexes.required_runs(r"\d{5}") == [] and dict(indexes.required_runs(r"\d{5}", unicode=False)[0])["digit"] == 5
    assert dict(indexes.required_runs(r"\[0-9]{5}")[0])["punct"] == 5


def test_known_plans():
    assert prefilter.trigram_plan(prefilter.facts("abcd")) == [[["abc", "bcd"]]]
    assert prefilter.trigram_plan(prefilter.facts("(?:abc|xyz)[0-9]+end")) == [[["end"]], [["abc"], ["xyz"]]]
    assert prefilter.trigram_plan(prefilter.facts("a|b")) == [] and prefilter.facts("a*").nullable


def test_columns_like_python(spark):
    df = spark.createDataFrame([("the cat, the hat",), ("",), (None,), ("xthe",)], "t string")
    got = df.select(M.match("t", Pattern("the")).alias("m"), M.findall("t", Pattern("(t)he"), 1).alias("f"), M.split("t", Pattern(", "), 1).alias("s")).collect()
    assert [r.m for r in got] == ["the", None, None, None] and got[0].f == ["t", "t"] and got[0].s == ["the cat", "the hat"]
    spans = df.select(M.finditer("[a-z](?=he)", start=1)(df.t).alias("x")).collect()
    assert [(y.start, y.end) for y in spans[0].x] == [(9, 10)] and spans[2].x is None
    assert [r.x for r in df.select(M.sub_with("t", lambda m: "T", most=1)(df.t).alias("x")).select("x.*").selectExpr("text as x").collect()][:2] == ["The cat, the hat", ""]


def test_unicode_facts():
    assert M.fold_orbit("k") == ["K", "k", "K"] and M.fold_orbit("ß") == ["ß", "ẞ"] or M.fold_orbit("ß") == ["ß"]
    assert M.property_ranges("Nd")[0] == (0x30, 0x39) and M.property_ranges("Cs") == [] and M.fold_orbit("µ") == ["µ", "Μ", "μ"]
