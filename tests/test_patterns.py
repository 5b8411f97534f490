import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from glyphlake.functions.patterns import Pattern, PatternError, group_names, needs_backtracking, quote, replacement, translate

PAIRS = [
    (r"\<foo", "a foo foobar xfoo"), (r"foo\>", "foo xfoo foox"), (r"[[:alpha:]]+[[:digit:]]", "abc1 1a b2"), (r"[a-z--[aeiou]]+", "hello strength"), (r"[a-z&&[^x-z]]+", "wxyz abc"),
    (r"[\w~~\d]+", "ab12_c"), (r"(?P<n>a+)b", "aab ab b"), (r"a|ab", "abab"), (r"x*", "axxb"), (r"[^]a]+", "]ab]c"), (r"\bé\w+", "été école"),
]


@pytest.mark.parametrize(("pattern", "text"), PAIRS)
def test_translated_patterns_find_what_the_dialect_finds(spark, pattern, text):
    peer = pattern.replace(r"\<", r"\b(?=\w)").replace(r"\>", r"\b(?<=\w)")
    want = [m[0] for m in regex.compile(peer, regex.V1).finditer(text) if m[0]]
    found = spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit(f"({Pattern(pattern).java()})"), F.lit(1)).alias("x")).first().x
    assert [x for x in found if x] == want


def test_case_folding_is_simple(spark):
    df = spark.createDataFrame([("STRASSE",), ("Straße",), ("STRAßE",), ("\u212a",)], "x string")
    assert [r.x for r in df.where(Pattern("straße", ignore_case=True).matches(F.col("x"))).collect()] == ["Straße", "STRAßE"]
    assert [r.x for r in df.where(Pattern("k", ignore_case=True).matches(F.col("x"))).collect()] == ["\u212a"]


def test_options(spark):
    df = spark.createDataFrame([("The cat",), ("the cat",), ("concat",), ("THE",), ("ÉTÉ",), ("été",)], "x string")
    hits = lambda p: [r.x for r in df.where(p.matches(F.col("x"))).collect()]
    assert hits(Pattern("the", smart_case=True)) == ["The cat", "the cat", "THE"]
    assert hits(Pattern("The", smart_case=True)) == ["The cat"]
    assert hits(Pattern(r"the\S", smart_case=True)) == []
    assert hits(Pattern("cat", word=True)) == ["The cat", "the cat"]
    assert hits(Pattern("été", ignore_case=True)) == ["ÉTÉ", "été"]
    assert hits(Pattern("the", fixed=True, whole_line=True, ignore_case=True)) == ["THE"]
    assert hits(Pattern("c(at", fixed=True)) == []


def test_backtracking_is_asked_for():
    for p in (r"a(?=b)", r"(a)\1", r"a++b", r"(?>a)", r"(?<!x)y", r"(?P=n)"):
        assert needs_backtracking(p)
        with pytest.raises(PatternError):
            Pattern(p).java()
    for p in (r"a\(?=b", r"[(?=]", r"(?:a)+", r"(?<n>a)", r"\\1"):
        assert not needs_backtracking(p), p


def test_quoting_any_text(spark):
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice("a.*[](){}\\^$|?+-#& \n\t~é") for _ in range(rng.randint(1, 8)))
        assert spark.range(1).select(F.rlike(F.lit(f"x{text}y"), F.lit(f"x{quote(text)}y"))).first()[0], repr(text)
        assert re.fullmatch(r"[\s\S]*", quote(text))


def test_templates_and_names(spark):
    assert group_names(r"(a)(?P<n>b)(?:c)(?<m>d)[(]\(") == ("", "n", "m")
    for template, want in (("<$1>", "<a>"), ("${n}$$", "b$"), ("$9x$", "$"), ("$0", "ab"), ("\\", "\\")):
        java = replacement(template, ("", "n"))
        got = spark.range(1).select(F.regexp_replace(F.lit("ab"), F.lit("(a)(b)"), F.lit(java))).first()[0]
        assert got == want, template


def test_unreadable_patterns():
    for p in ("[a", "[[:nope:]]", "a\\"):
        with pytest.raises(PatternError):
            translate(p)
