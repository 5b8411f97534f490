import pytest

from glyphlake import session
from glyphlake.corpus import Corpus
from glyphlake.operators import units

CODE = "import os\n\ndef alpha(x):\n    return beta(x) + 1\n\n\ndef beta(y):\n    # beta doubles\n    return 2 * y\n"


@pytest.fixture(scope="module")
def corpus(spark):
    shape = "def {0}(a, b):\n    c = a + b\n    d = {1}(c)\n    return [d, c, a, b, {2}]\n"
    rows = [(1, "a.py", CODE), (2, "b.py", shape.format("f", "g", 1) + shape.format("h", "k", 22)), (3, "c.py", "x = alpha(3)\n# alpha is used\n"), (4, "d.py", None)]
    return Corpus.from_rows(spark, rows)


def test_functions_and_their_lines(corpus):
    got = sorted((r.path, r.line_start, r.line_end, r.headline) for r in units.functions(corpus).collect())
    assert got == [("a.py", 3, 4, "def alpha(x):"), ("a.py", 7, 9, "def beta(y):"), ("b.py", 1, 4, "def f(a, b):"), ("b.py", 5, 8, "def h(a, b):")]
    assert [r.headline for r in units.enclosing(corpus, "a.py", 8).collect()] == ["def beta(y):"]


def test_concepts_are_functions_of_one_shape(corpus):
    got = units.concepts(corpus).collect()
    assert [(r.members, r.repeated_lines) for r in got] == [(["b.py#1-4", "b.py#5-8"], 4)]


def test_context_blast_provenance(corpus):
    assert [(r.path, r.line_start, r.uses) for r in units.context(corpus, "beta").collect()] == [("a.py", 7, 2), ("a.py", 3, 1)]
    got = {(r.role, r.path, r.line) for r in units.blast(corpus, "alpha").collect()}
    assert {("definition", "a.py", 3), ("dependent", "c.py", 1), ("comment", "c.py", 2), ("dependency", "a.py", 3)} <= got
    found = units.provenance(corpus, "we say: return beta(x) + 1, so").collect()
    assert [(r.source, r.line, r.verified) for r in found] == [("a.py", 4, True)]


def test_settings():
    s = session.Settings.parse('roots = ["src"]\nexclude = ["*.log"]\nskip = ["gen"]\n[types]\nproto = ["*.proto"]\n')
    assert s.roots == ("src",) and s.types == (("proto", ("*.proto",)),) and s.skips("gen") and s.filter().exclude == ("*.log", "gen/")
    assert session.Settings.governing(["x.toml", "a/b/x.toml", "a/x.toml"], "a/b/c") == "a/b/x.toml" and session.Settings.governing(["q/x.toml"], "a") is None
    with pytest.raises(ValueError):
        session.Settings.parse("nope = 1")


def test_answers_are_kept_by_snapshot(spark):
    answers = session.Answers(most=400, each=300)
    ask = lambda: spark.range(3)
    assert answers.get("s1", "q", ask) == answers.get("s1", "q", ask) and answers.hits == 1
    answers.get("s2", "q", ask)
    assert answers.hits == 1 and len(answers.kept) == 2
    answers.get("s2", "large", lambda: spark.range(1000))
    assert len(answers.kept) == 2


def test_cursors_and_budgets(spark):
    assert [r.id for r in session.rows(spark.range(10), 3)] == [0, 1, 2]
    seen = []
    assert session.push(spark.range(10), lambda r: seen.append(r.id) or len(seen) == 4) == 4
    with session.budget(spark, 60):
        assert spark.range(5).count() == 5
