import datetime
import itertools
import random

import pytest
import regex
from pyspark.sql import functions as F

from glyphlake import schemas
from glyphlake.corpus import Corpus
from glyphlake.functions.patterns import Pattern
from glyphlake.operators import graphs, indexes, kinship, lexing, ranking, substrings
from glyphlake.operators.patternsets import Needles, PatternSet, RowPlan, pattern_ends


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, f"d{i % 3}/f{i}.txt", "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return spark.createDataFrame(rows + [(60, "d0/x.txt", "aaaa"), (61, "d1/y.txt", "ab")], "doc_id long, path string, text string")


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_row_plan(spark):
    labels = PatternSet({"acme": Pattern("a"), "refund": Pattern("b"), "charge": Pattern("c")})
    rows = [(0, "services/acme.go", 3), (0, "services/acme.go", 9), (2, "services/acme.go", 9), (0, "services/b.go", 1), (1, "docs/c.md", 2), (0, "docs/c.md", 7)]
    frame = spark.createDataFrame([(p, line, i) for i, p, line in rows], "path string, line long, pattern_id long")
    assert [tuple(r) for r in RowPlan(labels, group="pattern").run(frame).collect()] == [("acme", 4), ("charge", 1), ("refund", 1)]
    assert [tuple(r) for r in RowPlan(labels, glob="services/**", group="file", limit=1).run(frame).collect()] == [("services/acme.go", 3)]
    assert [r.line for r in RowPlan(labels).run(frame).collect()] == [2, 7, 3, 9, 9, 1]
    assert schemas.conforms(frame.schema, 15) and schemas.conforms(RowPlan(labels, group="pattern").run(frame).schema, 16)


def test_each_pattern_answers_as_if_alone(docs):
    made = {"x": Pattern("a+b"), "y": Pattern("ca", fixed=True), "z": Pattern("^c")}
    corpus = Corpus(docs)
    hits = {(r.path, r.line, r.pattern_id) for r in PatternSet(made).line_hits(corpus).collect()}
    alone = {(r.path, r.line, i) for i, p in enumerate(made.values()) for r in PatternSet({"p": p}).line_hits(corpus).collect()}
    assert hits == alone and hits
    masks = {r.path: set(r.patterns) for r in PatternSet(made).document_mask(corpus).collect()}
    assert masks == {p: {i for q, _, i in hits if q == p} for p in {p for p, _, _ in hits}}


def test_needles_and_substrings(docs):
    known = texts(docs)
    places = lambda t, x: [i for i in range(len(t) - len(x) + 1) if t.startswith(x, i)]
    needles = ["aa", "b", "ab", "\n"]
    got = sorted((r.doc_id, r.needle_id, r.start, r.end) for r in Needles(needles).occurrences(docs).collect())
    assert got == sorted((d, k, p, p + len(x)) for d, t in known.items() for k, x in enumerate(needles) for p in places(t, x))
    assert substrings.count(docs, "aa").first().n == sum(len(places(t, "aa")) for t in known.values())
    assert {r.doc_id: r.n for r in substrings.tally(docs, "ab").collect()} == {d: n for d, t in known.items() if (n := len(places(t, "ab")))}
    with pytest.raises(ValueError):
        Needles([""])


def test_places_of_a_shelf(docs):
    known = texts(docs)
    catalog = substrings.shelf(docs)
    whole = "".join(known[k] + "\0" for k in sorted(known))
    got = {r.doc_id: (r.start, r.stop) for r in catalog.collect()}
    assert all(whole[a:b] == known[k] for k, (a, b) in got.items())
    spots = docs.sparkSession.range(len(whole)).select(F.col("id").alias("pos"))
    owner = [(k, i) for k in sorted(known) for i in range(len(known[k]) + 1)]
    assert {r.pos: (r.doc_id, r.offset) for r in substrings.document_at(spots, catalog).collect()} == dict(enumerate(owner))


def test_every_end_of_every_match(spark):
    lines = spark.createDataFrame([(1, "aab"), (2, "ba"), (3, "")], "doc_id long, line string").withColumn("line_number", F.lit(1))
    got = {(r.doc_id, r.pattern_id, r.end) for r in pattern_ends(lines, {"x": "a+", "y": "ab?"}).collect()}
    assert got == {(1, 0, 1), (1, 0, 2), (1, 1, 1), (1, 1, 2), (1, 1, 3), (2, 0, 2), (2, 1, 2)}


def test_an_index_never_answers(docs):
    rows, known = indexes.postings(docs), texts(docs)
    for literal in ("abc", "aaaa", "cab ", "ab", "a"):
        found = indexes.candidates_literal(rows, literal) if len(literal) > 2 else indexes.candidates_short(rows, docs, literal)
        want = {d for d, t in known.items() if literal in t}
        assert want <= {r.doc_id for r in found.collect()}
        assert {r.doc_id for r in indexes.verify(docs, found, Pattern(literal, fixed=True)).collect()} == want
    assert indexes.candidates_literal(rows, "ab") is None


def test_amended_index_is_a_new_one(docs):
    amendment = indexes.Amendment(docs.where("doc_id < 5").withColumn("text", F.lit("cabcab")), docs.where("doc_id between 10 and 15").select("doc_id"))
    got = {tuple(r) for r in amendment.apply(indexes.postings(docs)).collect()}
    assert got == {tuple(r) for r in indexes.postings(amendment.overlay(docs)).collect()}


def test_class_runs_only_prune(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab19XY_ .") for _ in range(40))) for i in range(80)]
    frame = indexes.with_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    for pattern in ("[0-9]{3}", r"\d{2}[A-Z]{2}", "[a-z]{4}|[0-9]{4}", "(a|b)+", "[ab]+_?"):
        kept = {r.doc_id for r in frame.where(indexes.survives(indexes.required_runs(pattern))).collect()}
        assert {i for i, t in rows if regex.search(pattern, t)} <= kept
    assert indexes.required_runs("(a|b)*") == [] and dict(indexes.required_runs("(a|b)+")[0])["hex"] == 1
    one = frame.where("doc_id = 0").first()
    assert one.run_digit == max((len(x) for x in regex.findall("[0-9]+", rows[0][1])), default=0)


def test_generations(spark, docs, tmp_path):
    indexes.persist_generation(spark, docs, str(tmp_path), "1")
    indexes.persist_generation(spark, docs.where("doc_id < 9"), str(tmp_path), "2")
    assert {tuple(r) for r in indexes.current_generation(spark, str(tmp_path)).collect()} == {tuple(r) for r in indexes.postings(docs.where("doc_id < 9")).collect()}


def test_freshness_counts_equal_clocks(spark):
    t = datetime.datetime(2024, 1, 2)
    files = spark.createDataFrame([(1, t, t), (2, t - datetime.timedelta(1), t - datetime.timedelta(1)), (3, None, None), (4, t - datetime.timedelta(1), t)], "doc_id long, mtime timestamp, ctime timestamp")
    assert {r.doc_id for r in indexes.changed(files, t).collect()} == {1, 3, 4}


def test_fusion(spark):
    rows = [(0, 5, 1, 0, 7, 2, False, False), (1, 5, 1, 3, 7, 0, False, False), (2, 9, 3, 0, 8, 1, True, False), (3, 1, 2, 0, 0, 1, False, True)]
    frame = spark.createDataFrame(rows, "doc_id long, matches long, best_line long, definition int, shape long, depth long, is_generated boolean, is_mirror boolean")
    got = {r.doc_id: r.score for r in ranking.fuse(frame).collect()}
    import math

    lexical, shallow = {2: 0, 0: 1, 1: 2, 3: 3}, {1: 0, 3: 1, 2: 2, 0: 3}
    for i, _, _, definition, shape, _, generated, mirror in rows:
        want = 1 / (60 + lexical[i]) + 0.25 / (60 + shallow[i]) + 2 / 60 / 3 * definition + (0 if generated or mirror else 3 / 60)
        want += 0.75 / 60 * math.log2(3 / {7: 2, 8: 1}[shape]) / math.log2(3) if shape else 0
        assert got[i] == pytest.approx(want)
    assert [r.doc_id for r in ranking.top(ranking.fuse(frame), 2).collect()] == sorted(got, key=lambda k: (-got[k], k))[:2]


def test_ranked_view(spark):
    rows = [(1, "src/a.py", "x = 1\ndef target(y):\n  return target"), (2, "src/b.py", "call(target)\n"), (3, "src/c.min.js", "target"), (4, "z/.cache/a.py", "def target(): pass"), (5, "n.py", "none")]
    got = {r.path: (r.line_number, r.kind, r["count"]) for r in ranking.ranked_view(Corpus.from_rows(spark, rows), Pattern("target", fixed=True), "target").collect()}
    assert got == {"src/a.py": (2, "definition", 2), "src/b.py": (1, "use", 1), "src/c.min.js": (1, "generated", 1), "z/.cache/a.py": (1, "mirror", 1)}


def test_graphs(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(25)]
    got = {r.node: r.label for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    group = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        joined = group[a] | group[b]
        for x in joined:
            group[x] = joined
    assert got == {x: min(g) for x, g in group.items()}
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 2.0), (0, 2, 5.0), (2, 0, 1.0), (3, 0, 1.0)], "src long, dst long, weight double")
    assert {r.node: r.value for r in graphs.distances(edges, 0).collect()} == {0: 0.0, 1: 2.0, 2: 4.0}
    assert {(r.src, r.dst): r.weight for r in graphs.closure(edges, graphs.TROPICAL).collect()}[(3, 2)] == 5.0
    dag = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 2)], "src long, dst long, weight long")
    assert {r.node: r.value for r in graphs.distances(dag, 0, graphs.COUNTING).collect()} == {0: 1, 1: 1, 2: 1, 3: 3}


def test_lexer(spark):
    rules = lexing.Rules((r"if", r"[a-z]+", r"[0-9]+", r"[0-9]+\.[0-9]+", r" "))
    frame = spark.createDataFrame([(1, "if iff 12 1.5?"), (2, None)], "doc_id long, text string")
    got = [(r.rule, r.token) for r in lexing.tokens(frame, rules).orderBy("start").collect()]
    assert got == [(0, "if"), (4, " "), (1, "iff"), (4, " "), (2, "12"), (4, " "), (3, "1.5"), (-1, "?")]
    assert lexing.longest_at(rules.compiled(), "if", 0) == (2, [0, 1]) and lexing.longest_at(rules.compiled(), "if", 0, frozenset([1])) == (2, [1])
    assert lexing.longest_at(lexing.Rules((r"a|ab|abc", r"ab?")).compiled(), "xabcd", 1) == (4, [0])
    assert lexing.shortest_at(rules.compiled(), "12", 0) == (1, [2])
    acted = lexing.actions(spark.createDataFrame([(1, "ab 12 ?x 3"), (2, "7 z"), (3, "")], "doc_id long, text string"), {r"\d+": "cast(token as int) + 1", r"\s+": None, r"[a-z]+": "upper(token)"})
    assert sorted(tuple(r) for r in acted.collect()) == [(1, 0, 2, "AB"), (1, 3, 0, "13"), (1, 6, -1, "?x 3"), (2, 0, 0, "8"), (2, 2, 2, "Z")]


def test_comment_spans(spark):
    text = 'a /* b "c" */ d "e // f" // g\nh'
    kinds = [text[a:b] for a, b, k in lexing.span_kinds(text, lexing.FAMILIES["c"]) if k == lexing.COMMENT]
    assert kinds == ['/* b "c" */', "// g"]
    assert "".join(text[a:b] for a, b, _ in lexing.span_kinds(text, lexing.FAMILIES["c"])) == text
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    inside = lexing.scoped_matches(frame, "[a-z]", (lexing.COMMENT,)).collect()
    assert [r.match for r in inside] == ["b", "c", "g"]


def test_nearest_names():
    assert lexing.edit_distance("abcd", "acbd") == 1 and lexing.edit_distance("kitten", "sitting") == 3
    assert lexing.nearest_name("contxt", ["context", "content"]) == "context" and lexing.nearest_name("ab", ["ac", "ad"]) is None


def test_windows_do_not_move_anchors(spark):
    frame = spark.createDataFrame([(1, 1, "éab ab")], "doc_id long, line_number long, line string")
    assert [(r.start, r.end) for r in lexing.spans(frame, "ab", start=1).collect()] == [(2, 4), (5, 7)]
    assert [(r.start, r.end) for r in lexing.spans(frame.select("doc_id", "line_number", F.lit("abcb").alias("line")), "b*").collect()] == [(0, 0), (1, 2), (2, 2), (3, 4), (4, 4)]


def test_kinship(spark):
    rng = random.Random(2)
    base = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(120))
    near = base.replace(base[100:110], "zzzzzzzzzz")
    rows = [(1, "a", base), (2, "b", base), (3, "c", near), (4, "d", " ".join(str(rng.random()) for _ in range(60))), (5, "e", "")]
    known = kinship.sketches(spark.createDataFrame(rows, "doc_id long, path string, text string")).cache()
    sketches = {r.path: r.sketch for r in known.collect()}

    def apart(x, y):
        union = sorted({*sketches[x], *sketches[y]})[: kinship.SKETCH]
        return 1 - len(set(union) & set(sketches[x]) & set(sketches[y])) / len(union)

    got = {(r.a, r.b): r.distance for r in kinship.pairs(known, 0.6).collect()}
    assert got == {(x, y): pytest.approx(apart(x, y)) for x, y in itertools.combinations("acd", 2) if apart(x, y) <= 0.6}
    assert {tuple(r.paths) for r in kinship.clusters(known, 0.6).collect()} == {("a", "b", "c")}
    assert {r.path for r in kinship.distinct_members(known, 0.6).collect()} == {"d", "e"}
    first = kinship.similar(known, known.where("path = 'a'")).collect()
    assert [r.path for r in first[:3]] == ["a", "b", "c"] and first[0].grade == "identical" and first[0].distance == 0
    assert [tuple(r.members) for r in kinship.families(known, 0.6, "copies").collect()] == [("a", "b", "c")]


def test_copies_at_distance_0_are_listed(spark):
    rng = random.Random(7)
    base = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(120))
    other = " ".join(str(rng.random()) for _ in range(60))
    rows = [(k, f"p{k}", base) for k in range(5)] + [(5, "q", base.replace(base[100:104], "zzzz")), (6, "r", other), (7, "s", other), (8, "t", ""), (9, "u", "")]
    got = kinship.dup_pairs(kinship.sketches(spark.createDataFrame(rows, "doc_id long, path string, text string")), 0.6).collect()
    assert {(r.a, r.b) for r in got if r.role == "member"} == {("p0", f"p{k}") for k in range(1, 5)} | {("r", "s"), ("t", "u")}
    assert {(r.a, r.b) for r in got if r.role == "pair"} == {("p0", "q")}
    assert all((r.distance == 0 and r.grade == "identical") == (r.role == "member") for r in got)


def test_echoes_of_equal_silhouettes(spark):
    rng = random.Random(8)

    def code(shape):
        return " ".join(f"{rng.choice('abcdef') * rng.randint(2, 9)}{rng.randint(0, 99999)} {op} {rng.random()} ;" for op in shape)

    one, two = "+-*/+*-+" * 3, "+-*/+*-+" * 3 + "%"
    texts = [code(one) for _ in range(4)] + [code(two) for _ in range(3)]
    texts += [texts[1], texts[1], texts[5], "", "a b"]
    known = kinship.sketches(spark.createDataFrame([(k, f"p{k:02}", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")).cache()
    facts = {r.path: (set(r.sketch), set(r.silhouette)) for r in known.collect()}
    first = {}
    for path in sorted(facts):
        first.setdefault(repr([sorted(x) for x in facts[path]]), path)

    def apart(x, y, k, size):
        union = sorted(facts[x][k] | facts[y][k])[:size]
        return 1 - len(set(union) & facts[x][k] & facts[y][k]) / len(union)

    want = {}
    for x, y in itertools.combinations(sorted(p for p in first.values() if facts[p][1]), 2):
        structure, byte = apart(x, y, 1, kinship.SILHOUETTE), apart(x, y, 0, kinship.SKETCH)
        if structure <= 0.5 and byte - structure >= min(b for _, b in kinship.GAP_BOUNDS):
            want[x, y] = (pytest.approx(byte), pytest.approx(structure))
    got = kinship.echoes(known).collect()
    assert {tuple(sorted((r.a, r.b))): (r.byte_distance, r.structure_distance) for r in got if r.role == "pair"} == want
    assert sum(r.role == "pair" for r in got) == len(want) and ("p00", "p01") in want and ("p00", "p04") in want
    assert {(r.a, r.b) for r in got if r.role == "member"} == {("p01", "p07"), ("p01", "p08"), ("p05", "p09")}


def test_quotation_and_packing(spark):
    frame = spark.createDataFrame([(1, "a", "the quick brown fox"), (2, "b", "lazy dogs sleep all day"), (3, "c", None)], "doc_id long, path string, text string")
    query = "a quick brown cat and lazy dogs sleep"
    assert [(r.text, r.source) for r in kinship.quote(frame, query).collect()] == [("lazy dogs sleep", "b"), (" quick brown ", "a")]
    gains = {r.path: r.gain for r in kinship.recall(frame, query).collect()}
    assert gains["b"] > gains["a"] > gains["c"] == 0
    assert [r.path for r in kinship.pack(frame, "quick brlazy dog", chunk=8).collect()] == ["a", "b"]


def test_symbols(spark):
    lines = Corpus.from_rows(spark, [(1, "a", "def alpha():\n  beta()"), (2, "b", "def beta(): pass"), (3, "c", "alpha()")]).lines()
    assert sorted((r.path, r.line, r.defines) for r in kinship.references(lines, "alpha").collect()) == [("a", 1, True), ("c", 1, False)]
    assert {(r.path, r.hops) for r in kinship.ripple(lines, "beta").collect()} == {("a", 1), ("c", 2)}


def test_declared_schemas():
    assert len(schemas.SCHEMAS) == 22 and all(len(s) <= 64 for _, s in schemas.SCHEMAS.values())


def test_a_shelf_keeps_documents_without_an_id_and_far_ids(spark):
    docs = spark.createDataFrame([(None, "ab"), (5, "abc"), (2**40, "x"), (7, ""), (None, None)], "doc_id long, text string")
    rows = sorted(tuple(r) for r in substrings.shelf(docs).select("start", "stop", "doc_id").collect())
    assert rows[:3] == [(0, 3, 5), (4, 4, 7), (5, 6, 2**40)] and [r[2] for r in rows[3:]] == [None, None] and rows[3][0] == 7
    asked = substrings.document_at(spark.createDataFrame([(0,), (4,), (6,), (7,)], "pos long"), substrings.shelf(docs)).collect()
    assert sorted((r.pos, r.doc_id, r.offset) for r in asked if r.pos < 7) == [(0, 5, 0), (4, 7, 0), (6, 2**40, 1)] and [r.doc_id for r in asked if r.pos == 7] == [None]


@pytest.mark.parametrize("threshold", [0.0, 0.25, 0.5, 0.75])
def test_pairs_of_any_sets_are_those_of_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    sets = [()]
    for _ in range(25):
        base = rng.sample(range(300), rng.randint(1, 40))
        for _ in range(3):  # and others near it
            sets.append(tuple(sorted({h if rng.random() > 0.1 else rng.randrange(300) for h in base} | {7})))
    rows = [(f"p{i:03}", list(s)) for i, s in enumerate(sets)] + [("q", list(sets[5])), (None, [1, 2])]
    known = spark.createDataFrame(rows, "path string, sketch array<long>")
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(s, f"p{i:03}")
    want = {}
    for (s, x), (t, y) in itertools.combinations(first.items(), 2):
        union = sorted({*s, *t})[: kinship.SKETCH]
        apart = 1 - len(set(union) & set(s) & set(t)) / len(union)
        if apart <= threshold:
            want[min(x, y), max(x, y)] = pytest.approx(apart)
    assert {(r.a, r.b): r.distance for r in kinship.pairs(known, threshold).collect()} == want
    if threshold == 0.5:
        near = kinship.nearest_misses(known.where("path is not null"), 0.25, 0.5).collect()
        linked = {p for (a, b), d in want.items() if d.expected <= 0.25 for p in (a, b)}
        alike = [tuple(s) for p, s in rows if p]
        close = {p for p, s in rows if p and s and (first[tuple(s)] in linked or alike.count(tuple(s)) > 1)}
        assert {r.path for r in near} == {p for p, _ in rows if p} - close
        for r in near:
            met = sorted((d.expected, b if a == r.path else a) for (a, b), d in want.items() if r.path in (a, b))
            assert (r.nearest is None) == (not met) and (not met or r.distance == pytest.approx(met[0][0]))


def test_span_kinds_end_with_text_and_line():
    kinds = lambda text, family: lexing.span_kinds(text, lexing.FAMILIES[family])
    assert kinds('a "b\\"c" // d\ne /* f', "c") == [(0, 2, 0), (2, 8, 2), (8, 9, 0), (9, 13, 1), (13, 16, 0), (16, 20, 1)]
    assert kinds("x 'y\nz'", "hash") == [(0, 2, 0), (2, 4, 2), (4, 6, 0), (6, 7, 2)] and kinds("", "c") == []


def test_packed_items_are_the_greedy_ones(spark):
    rng = random.Random(4)
    docs = [(f"d{i}", "".join(rng.choice("ab ") for _ in range(40))) for i in range(30)]
    query = "".join(rng.choice("ab ") for _ in range(60))
    chunks = [query[i : i + 6] for i in range(0, 55, 6)]
    open_chunks, want = set(range(len(chunks))), []
    while len(want) < 10:
        gain, path = min((-8.0 * sum(len(chunks[k]) for k in open_chunks if chunks[k] in t), p) for p, t in docs)
        if not gain:
            break
        open_chunks -= {k for k in open_chunks if chunks[k] in dict(docs)[path]}
        want.append((path, -gain))
    got = kinship.pack(spark.createDataFrame(docs, "path string, text string"), query, chunk=6).collect()
    assert [r.marginal_bits for r in got] == [g for _, g in want] and got[0].path == want[0][0]
