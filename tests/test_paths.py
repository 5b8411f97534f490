import fnmatch

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import paths as P

PATHS = [
    "a.go", "x/a.go", "services/a/b.go", "services/b.go", "outreach_pb2.py", "x/_pb2.py", "docs/conf.py", "docs/guide", "CHANGELOG.old", "README", "v1.2/Makefile", ".git/x", "a/.hid/b",
    "build/x.c", "x/build", "a[b].txt", "deep/a/b/c.txt", "./target/semver-checks/a.rs", "x/.cache/y", "data.json", "n.generated.ts", "Doc/readme.txt", "a/b", "a-b",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def hits(frame, condition):
    return {r.path for r in frame.where(condition).collect()}


def test_globs(frame):
    path = F.col("path")
    assert hits(frame, P.glob_applies(path, "*.go")) == {"a.go", "x/a.go", "services/a/b.go", "services/b.go"}
    assert hits(frame, P.glob_applies(path, "services/**/*.go")) == {"services/a/b.go", "services/b.go"}
    assert hits(frame, P.glob_applies(path, "services/*.go")) == {"services/b.go"}
    assert hits(frame, P.glob_applies(path, "**/_pb2*")) == {"x/_pb2.py"}
    assert hits(frame, P.glob_applies(path, "build/")) == {"build/x.c"}
    assert hits(frame, P.glob_applies(path, "a[b].txt")) == set() and hits(frame, P.glob_applies(path, "a[[]b].txt")) == {"a[b].txt"}
    assert hits(frame, P.glob_applies(path, "*.{json,c}")) == {"data.json", "build/x.c"}
    assert hits(frame, P.glob_applies(path, "readme*", ignore_case=True)) == {"README", "Doc/readme.txt"}


def test_names_like_fnmatch(frame):
    for glob in ("*", "a*", "?.go", "[a-c]*", "[!a]*", "*.txt"):
        want = {p for p in PATHS if fnmatch.fnmatchcase(p.rpartition("/")[2], glob)}
        assert hits(frame, P.glob_applies(F.col("path"), glob)) == want, glob


def test_braces():
    assert P.brace_expand("a{b,c{d,e}}f{,g}") == ["abf", "abfg", "acdf", "acdfg", "acef", "acefg"]
    assert P.brace_expand("a{b") == ["a{b"]
    with pytest.raises(ValueError):
        P.brace_expand("{a,b}" * 11)
    with pytest.raises(ValueError):
        P.brace_expand("{a}" * 70)


def test_kinds(frame):
    kind = {r.path: r.g for r in frame.select("path", P.genus(F.col("path")).alias("g")).collect()}
    assert kind["docs/conf.py"] == "code" and kind["docs/guide"] == "docs" and kind["CHANGELOG.old"] == "docs" and kind["README"] == "docs"
    assert kind["data.json"] == "data" and kind["a.go"] == "code" and kind["v1.2/Makefile"] == "code"
    assert hits(frame, P.is_mirror(F.col("path"))) == {"./target/semver-checks/a.rs", "x/.cache/y"}
    assert hits(frame, P.is_generated_path(F.col("path"))) == {"outreach_pb2.py", "x/_pb2.py", "n.generated.ts"} - {"outreach_pb2.py", "x/_pb2.py"} | {"outreach_pb2.py", "x/_pb2.py"}
    assert hits(frame, P.hidden(F.col("path"))) == {".git/x", "a/.hid/b", "x/.cache/y"}
    assert hits(frame, P.in_skipped_dir(F.col("path"))) == {".git/x", "build/x.c", "x/.cache/y", "./target/semver-checks/a.rs"}


def test_generated_headers(spark):
    rows = [("a", "// Code generated by x. DO NOT EDIT.\npackage a"), ("b", "package b\n" * 9 + "// generated by x"), ("c", "#!/bin/sh\n\n# autogenerated\n"), ("d", "plain"), ("e", "// c\n" * 20 + "// @generated"), ("f", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    assert hits(df, P.is_generated(F.col("path"), F.col("text"))) == {"a", "c", "e"}


def test_component_order(frame):
    got = [r.path for r in frame.where("path in ('a/b', 'a-b', 'a.go')").orderBy(P.path_order(F.col("path"))).collect()]
    assert got == ["a/b", "a-b", "a.go"]


def test_ignore_rules(spark, frame):
    rules = P.parse_ignore("# c\n*.go\n!services/**\n/build/\n\\#x\nx/a.go \n!b.go\n") + P.parse_ignore("!a.go\n", "x", 100)
    constant = hits(frame, P.ignored(frame, rules))
    assert constant == {"a.go", "build/x.c"}
    joined = {r.path for r in P.last_rule(frame, P.rules_frame(spark, rules)).where("ignored").collect()}
    assert joined == constant


def test_filters(frame):
    path = F.col("path")
    assert hits(frame, P.PathFilter(roots=("services",), exclude=("b.go",)).admits(path)) == set()
    assert hits(frame, P.PathFilter(types=("go",), not_types=("py",)).admits(path)) == {"a.go", "x/a.go", "services/a/b.go", "services/b.go"}
    assert hits(frame, P.PathFilter(include=("*.txt",), types=("go",)).admits(path)) == {"a[b].txt", "deep/a/b/c.txt", "Doc/readme.txt"}
    assert hits(frame, P.PathFilter(genera=("data",), max_depth=1).admits(path)) == {"data.json"}
