"""Queries of line search, its modes, projections and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus, is_binary, split_lines
from ..functions import paths as P
from ..functions.patterns import Pattern, either
from ..operators import indexes, search
from ..sources import sinks
from ..storage import global_rank
from .registry import DOCS, LINES, corpus, query, table

YEAR = Pattern("[0-9]{4}")
HEX = Pattern("[0-9a-f]{12}")
LICENSE = Pattern("license", fixed=True, ignore_case=True)
MAIL = Pattern(r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+")
THE = Pattern("the", fixed=True)


@query(f"WITH {LINES} SELECT DISTINCT path FROM lines WHERE regexp_matches(line, '[0-9]{{4}}')")
def files_with_matches(spark: SparkSession, d: str) -> DataFrame:
    return search.files_with_matches(corpus(spark, d), YEAR)


@query(f"WITH {LINES} SELECT path FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE regexp_matches(line, '[0-9]{{4}}'))")
def files_without_match(spark: SparkSession, d: str) -> DataFrame:
    return search.files_without_match(corpus(spark, d), YEAR)


@query(f"WITH {LINES} SELECT count(*) > 0 AS found FROM lines WHERE contains(line, 'GNU')")
def exists_quiet(spark: SparkSession, d: str) -> DataFrame:
    hits = search.files_with_matches(corpus(spark, d), Pattern("GNU", fixed=True)).limit(1)
    return hits.agg((F.count(F.lit(1)) > 0).alias("found"))


@query(f"WITH {LINES} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, '[0-9a-f]{{12}}') GROUP BY path")
def count_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.count_lines(corpus(spark, d), HEX)


@query(f"WITH {LINES} SELECT path, CAST(sum(len(regexp_extract_all(line, '[0-9]{{4}}'))) AS BIGINT) AS n FROM lines GROUP BY path HAVING n > 0")
def count_matches(spark: SparkSession, d: str) -> DataFrame:
    return search.count_matches(corpus(spark, d), YEAR)


@query(f"WITH {LINES} SELECT d.path, count(l.doc_id) AS n FROM docs d LEFT JOIN (SELECT doc_id FROM lines WHERE regexp_matches(line, '(?i)license')) l USING (doc_id) GROUP BY d.path")
def count_include_zero(spark: SparkSession, d: str) -> DataFrame:
    return search.count_lines(corpus(spark, d), LICENSE, include_zero=True)


@query(f"WITH {LINES} SELECT path, least(count(*), 3) AS n FROM lines WHERE contains(line, 'the') GROUP BY path")
def capped_count(spark: SparkSession, d: str) -> DataFrame:
    return search.count_lines(corpus(spark, d), THE, cap=3)


@query(
    f"WITH {LINES} SELECT path, line_number, CAST(strlen(regexp_extract(line, '^(.*?)[0-9]{{4}}', 1)) + 1 AS BIGINT) AS \"column\", line FROM lines WHERE regexp_matches(line, '[0-9]{{4}}')"
)
def match_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.with_position(search.matching_lines(corpus(spark, d), YEAR), YEAR).select("path", "line_number", "column", "line")


@query(f"WITH {LINES} SELECT path, line_number FROM lines WHERE NOT contains(line, 'the')")
def invert_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(corpus(spark, d), THE, invert=True).select("path", "line_number")


@query(f"WITH {LINES} SELECT path, line_number FROM lines WHERE contains(line, 'The')")
def fixed_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(corpus(spark, d), Pattern("The", fixed=True)).select("path", "line_number")


@query(f"WITH {LINES} SELECT path, line_number FROM lines WHERE regexp_matches(line, '(?i)license')")
def caseless_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(corpus(spark, d), LICENSE).select("path", "line_number")


@query(f"WITH {LINES} SELECT path, line_number, 'folded' AS mode FROM lines WHERE regexp_matches(line, '(?i)gnu') UNION ALL SELECT path, line_number, 'exact' AS mode FROM lines WHERE regexp_matches(line, 'Gnu|GNU')")
def smart_case_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus(spark, d).lines()
    folded = lines.where(Pattern("gnu", smart_case=True).matches(F.col("line"))).select("path", "line_number", F.lit("folded").alias("mode"))
    return folded.unionByName(lines.where(Pattern("Gnu|GNU", smart_case=True).matches(F.col("line"))).select("path", "line_number", F.lit("exact").alias("mode")))


@query(f"WITH {LINES} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, '(^|[^0-9A-Za-z_])(the|of)($|[^0-9A-Za-z_])') GROUP BY path")
def word_lines(spark: SparkSession, d: str) -> DataFrame:
    found = search.matching_lines(corpus(spark, d), Pattern("the|of", word=True, unicode=False))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT path, line_number, line FROM lines WHERE regexp_matches(line, '^[A-Za-z]+\\.$')")
def line_regexp(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(corpus(spark, d), Pattern(r"[A-Za-z]+\.", whole_line=True)).select("path", "line_number", "line")


@query(f"WITH {DOCS} SELECT path FROM docs WHERE regexp_matches(text, '\\.\\nThe ')")
def multiline_docs(spark: SparkSession, d: str) -> DataFrame:
    return search.multiline_docs(corpus(spark, d), Pattern(r"\.\nThe "))


@query(f"WITH {LINES} SELECT DISTINCT a.path, CAST(a.line_number + k.k AS BIGINT) AS line_number FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_number = a.line_number + 1, (VALUES (0), (1)) k(k) WHERE a.line LIKE '%.' AND b.line LIKE 'The %'")
def multiline_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.multiline_lines(corpus(spark, d), Pattern(r"\.\nThe ")).select("path", "line_number")


@query(f"WITH {DOCS} SELECT path, CAST(length(text) - length(regexp_replace(text, '(?s)The.{{3,9}}?[.]', '', 'g')) AS BIGINT) AS n FROM docs WHERE regexp_matches(text, '(?s)The.{{3,9}}?[.]')")
def dotall_spans(spark: SparkSession, d: str) -> DataFrame:
    p = Pattern("The.{3,9}?[.]", dotall=True)
    return corpus(spark, d).df.where(p.matches(F.col("text"))).select("path", (F.length("text") - F.length(F.regexp_replace("text", p.java(), ""))).cast("long").alias("n"))


@query(f"WITH {LINES} SELECT path, line_number FROM lines WHERE regexp_matches(line, '[0-9]{{3}}[-][0-9]{{3}}')")
def verbose_pattern(spark: SparkSession, d: str) -> DataFrame:
    p = Pattern("[0-9]{3}  # prefix\n [-] [0-9]{3}", verbose=True)
    return search.matching_lines(corpus(spark, d), p).select("path", "line_number")


@query(f"""WITH {LINES}, m AS (SELECT *, contains(line, 'the') AS hit FROM lines),
r AS (SELECT *, max(hit::INT) OVER w AS seen FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_number ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, max((NOT hit AND seen = 1)::INT) OVER (PARTITION BY doc_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS broken FROM r)
SELECT path, line_number FROM b WHERE hit AND broken = 0""")
def stop_on_nonmatch(spark: SparkSession, d: str) -> DataFrame:
    return search.stop_on_nonmatch(corpus(spark, d).lines(), THE.matches(F.col("line"))).select("path", "line_number")


@query(f"""WITH {DOCS}, parts AS (SELECT path, string_split(text, '. ') AS p FROM docs),
recs AS (SELECT path, CAST(i AS BIGINT) AS record, p[i] AS body FROM parts, LATERAL (SELECT unnest(generate_series(1, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END)) AS i))
SELECT path, count(*) AS n FROM recs WHERE regexp_matches(body, '[0-9]') GROUP BY path""")
def record_search(spark: SparkSession, d: str) -> DataFrame:
    """Records between any separator; NUL is one."""
    docs = corpus(spark, d).df.select("doc_id", "path", F.replace("text", F.lit(". "), F.lit("\0")).alias("text"))
    found = search.records(Corpus(docs), "\0", Pattern("[0-9]"))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS lines FROM conversations")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines with CRLF ends, counted after the carriage return is taken off."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"))
    lines = split_lines(turns, "\n").withColumn("line", F.regexp_replace("line", "\r$", ""))
    counted = lines.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    return turns.join(counted, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("n", F.lit(0)).cast("long").alias("lines"))


@query(f"""WITH {LINES}, m AS (SELECT path, line_number, regexp_extract_all(line, '[A-Za-z0-9_.]+@[A-Za-z0-9_.]+') AS a FROM lines)
SELECT path, line_number, CAST(i AS BIGINT) AS ordinal, a[i] AS "match" FROM m, LATERAL (SELECT unnest(generate_series(1, len(a))) AS i)""")
def only_matching(spark: SparkSession, d: str) -> DataFrame:
    return search.only_matching(corpus(spark, d).lines(), MAIL).drop("doc_id")


@query(f"WITH {LINES} SELECT path, line_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS r FROM lines WHERE contains(line, 'the')) WHERE r <= 2")
def max_count_per_file(spark: SparkSession, d: str) -> DataFrame:
    return search.cap_per_file(search.matching_lines(corpus(spark, d), THE), 2).select("path", "line_number")


@query(f"""WITH {LINES}, m AS (SELECT *, regexp_matches(line, '[0-9]{{4}}') AS hit FROM lines),
n AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM m),
j AS (SELECT *, coalesce((line_number - lag(line_number) OVER (PARTITION BY doc_id ORDER BY line_number) > 1)::INT, 0) AS jump FROM n WHERE near = 1)
SELECT path, line_number, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind,
       CAST(1 + sum(jump) OVER (PARTITION BY doc_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM j""")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.with_context(corpus(spark, d).lines(), YEAR.matches(F.col("line")), before=2, after=1).drop("doc_id")


@query(f"WITH {LINES} SELECT path, line_number, contains(line, 'the') AS is_match FROM lines")
def passthru_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.passthru(corpus(spark, d).lines(), THE.matches(F.col("line"))).select("path", "line_number", "is_match")


@query(f"WITH {LINES} SELECT path, line_number, regexp_replace(line, '([A-Za-z0-9_.]+)@([A-Za-z0-9_.]+)', '<\\2 at \\1$>', 'g') AS line FROM lines WHERE regexp_matches(line, '([A-Za-z0-9_.]+)@([A-Za-z0-9_.]+)')")
def replace_lines(spark: SparkSession, d: str) -> DataFrame:
    p = Pattern(r"(?P<user>[A-Za-z0-9_.]+)@(?P<host>[A-Za-z0-9_.]+)")
    return search.replace_matches(corpus(spark, d).lines(), p, "<${host} at $1$$>", ("user", "host")).select("path", "line_number", "line")


@query(f"WITH {LINES} SELECT path, line_number, CASE WHEN length(line) > 60 THEN left(line, 60) || ' [...]' ELSE line END AS preview FROM lines WHERE contains(line, 'the')")
def trimmed_preview(spark: SparkSession, d: str) -> DataFrame:
    lines = search.matching_lines(corpus(spark, d), THE)
    return lines.select("path", "line_number", search.trimmed(F.col("line"), 60, preview=True).alias("preview"))


@query(f"""WITH {LINES}, m AS (SELECT path, line_number, trim(line, chr(32) || chr(9)) AS t FROM lines WHERE regexp_matches(line, '[0-9]{{4}}')),
p AS (SELECT *, length(regexp_extract(t, '^(.*?)[0-9]{{4}}', 1)) + 1 AS pos, length(t) AS n FROM m),
q AS (SELECT *, greatest(1, least(pos - 30, n - 119)) AS s FROM p)
SELECT path, line_number, (CASE WHEN s > 1 THEN '…' ELSE '' END) || substr(t, s, 120) || (CASE WHEN s + 119 < n THEN '…' ELSE '' END) AS snippet FROM q""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    lines = search.matching_lines(corpus(spark, d), YEAR)
    return lines.select("path", "line_number", search.snippet(F.col("line"), YEAR).alias("snippet"))


@query(f"WITH {LINES} SELECT path, line_number, regexp_extract(line, '([A-Za-z0-9_.]+)@([A-Za-z0-9_.]+)', 1) AS user, regexp_extract(line, '([A-Za-z0-9_.]+)@([A-Za-z0-9_.]+)', 2) AS host FROM lines WHERE regexp_matches(line, '([A-Za-z0-9_.]+)@([A-Za-z0-9_.]+)')")
def captures(spark: SparkSession, d: str) -> DataFrame:
    p = Pattern(r"([A-Za-z0-9_.]+)@([A-Za-z0-9_.]+)")
    return search.captures(corpus(spark, d).lines(), p, {"user": 1, "host": 2}).drop("doc_id")


@query(f"WITH {LINES} SELECT path, line_number FROM lines WHERE regexp_matches(line, '(?:[0-9]{{4}})|(?:[0-9a-f]{{12}})|(?:(?i)license)')")
def any_of_patterns(spark: SparkSession, d: str) -> DataFrame:
    return search.any_pattern(corpus(spark, d), [YEAR, HEX, LICENSE]).select("path", "line_number")


@query(f"WITH {DOCS} SELECT path FROM docs WHERE contains(text, 'GNU') OR contains(text, 'MIT') OR contains(text, '@')")
def any_literal_docs(spark: SparkSession, d: str) -> DataFrame:
    words = [Pattern(x, fixed=True) for x in ("GNU", "MIT", "@")]
    found = words[0].matches(F.col("text")) | words[1].matches(F.col("text")) | words[2].matches(F.col("text"))
    return corpus(spark, d).df.where(found).select("path")


@query(f"""WITH {LINES}, l AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '[0-9]{{4}}')) AS ml, sum(len(regexp_extract_all(line, '[0-9]{{4}}'))) AS m FROM lines GROUP BY doc_id)
SELECT (SELECT count(*) FROM docs) AS files, CAST(count(*) FILTER (ml > 0) AS BIGINT) AS files_matched, CAST(sum(ml) AS BIGINT) AS lines_matched, CAST(sum(m) AS BIGINT) AS matches,
       (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM docs) AS bytes_searched FROM l""")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.stats(corpus(spark, d), YEAR)


@query(f"WITH {LINES} SELECT 'year' AS label, count(DISTINCT doc_id) AS files FROM lines WHERE regexp_matches(line, '[0-9]{{4}}') UNION ALL SELECT 'none', count(DISTINCT doc_id) FROM lines WHERE contains(line, 'zzzzqq') UNION ALL SELECT 'license', count(DISTINCT doc_id) FROM lines WHERE regexp_matches(line, '(?i)license')")
def dead_branches(spark: SparkSession, d: str) -> DataFrame:
    return search.dead_branches(corpus(spark, d), {"year": YEAR, "none": Pattern("zzzzqq", fixed=True), "license": LICENSE})


@query(f"WITH {DOCS} SELECT path, contains(left(text, 8192), chr(0)) AS is_binary, (strlen(text) BETWEEN 1 AND 4194304) AND NOT contains(left(text, 8192), chr(0)) AS member FROM docs")
def binary_files(spark: SparkSession, d: str) -> DataFrame:
    member = F.octet_length("text").between(1, 4 << 20) & ~is_binary(F.col("text"))
    return corpus(spark, d).df.select("path", is_binary(F.col("text")).alias("is_binary"), member.alias("member"))


# paths


@query(f"WITH {DOCS} SELECT path, CAST(strlen(text) AS BIGINT) AS size FROM docs")
def census(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).census().select("path", "size")


@query(f"WITH {DOCS} SELECT path, text FROM docs WHERE doc_id = 42")
def recall_document(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).recall(42).select("path", "text")


@query(f"WITH {DOCS} SELECT path FROM docs WHERE regexp_matches(path, '^src1[0-9]?/[^/]*/[^/]*[.]txt$')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).df.where(P.glob_applies(F.col("path"), "src1*/**/*.txt")).select("path")


@query(f"WITH {DOCS} SELECT path FROM docs WHERE regexp_matches(path, '^src[02]/(de|fr)/[0-9]*[05][.]txt$')")
def brace_globs(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).df.where(P.glob_applies(F.col("path"), "src{0,2}/{de,fr}/*[05].txt")).select("path")


@query(f"WITH {DOCS} SELECT path FROM docs WHERE (path LIKE 'src3/%' OR path LIKE 'src4/%') AND NOT path LIKE '%/es/%' AND path LIKE '%.txt'")
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = P.PathFilter(roots=("src3", "src4/"), exclude=("**/es/**",), types=("txt",))
    return corpus(spark, d).df.where(wanted.admits(F.col("path"))).select("path")


VARIANTS = "path || CASE CAST(doc_id AS BIGINT) % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.generated.go' WHEN 4 THEN '.min.js' WHEN 5 THEN '/docs/conf.py' WHEN 6 THEN '/docs/CHANGELOG' ELSE '' END"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Paths with several endings, as the tables have only one."""
    ends = [".py", ".md", ".json", ".generated.go", ".min.js", "/docs/conf.py", "/docs/CHANGELOG", ""]
    tail = F.element_at(F.array(*[F.lit(x) for x in ends]), (F.col("doc_id") % 8 + 1).cast("int"))
    return corpus(spark, d).df.select("doc_id", F.concat("path", tail).alias("path"), "text")


@query(f"WITH {DOCS}, v AS (SELECT {VARIANTS} AS path FROM docs) SELECT path FROM v WHERE path LIKE '%.py' OR path LIKE '%.json'")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).where(P.of_type(F.col("path"), "py", "json")).select("path")


@query(f"""WITH {DOCS}, v AS (SELECT doc_id % 8 AS k, {VARIANTS} AS path FROM docs)
SELECT path, CASE WHEN k IN (0, 3, 4, 5) THEN 'code' WHEN k = 2 THEN 'data' ELSE 'docs' END AS genus FROM v""")
def genus_partition(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("path", P.genus(F.col("path")).alias("genus"))


@query(f"WITH {DOCS}, v AS (SELECT doc_id % 8 AS k, {VARIANTS} AS path, text FROM docs) SELECT path, k IN (3, 4) OR regexp_matches(text, '(?i)^(code generated|generated by|@generated|do not edit)') AS generated FROM v")
def generated_files(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("path", P.is_generated(F.col("path"), F.col("text")).alias("generated"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{g}')" for n, (_, globs) in P.TYPES.items() for g in globs) + ') t("type", "glob")')
def type_list(spark: SparkSession, d: str) -> DataFrame:
    return P.type_table(spark)


@query(f"WITH {DOCS}, v AS (SELECT {VARIANTS} AS path FROM docs) SELECT CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth, regexp_extract(path, '[.]([^./]+)$', 1) AS ext, count(*) AS n FROM v GROUP BY ALL")
def depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = _variants(spark, d)
    return v.groupBy(P.depth(F.col("path")).alias("depth"), F.coalesce(P.extension(F.col("path")), F.lit("")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DOCS}, v AS (SELECT path, CASE doc_id % 4 WHEN 0 THEN 'build/' WHEN 1 THEN '.hidden/' WHEN 2 THEN 'a/node_modules/' ELSE '' END || path AS p FROM docs)
SELECT p AS path FROM v WHERE NOT (p LIKE 'build/%' OR p LIKE '.hidden/%' OR p LIKE 'a/node_modules/%')""")
def walk_policy(spark: SparkSession, d: str) -> DataFrame:
    """Hidden files and skipped folders left out."""
    head = F.element_at(F.array(*[F.lit(x) for x in ("build/", ".hidden/", "a/node_modules/", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    v = corpus(spark, d).df.select(F.concat(head, "path").alias("path"))
    return v.where(~P.hidden(F.col("path")) & ~P.in_skipped_dir(F.col("path")))


IGNORE = "*.txt\n!src1/**\n/src1/de/\nsrc2/fr/*1.txt\n!*7.txt\n"


@query(f"""WITH {DOCS} SELECT path, CASE
  WHEN regexp_matches(path, '(^|/)[^/]*7[.]txt(/|$)') THEN false
  WHEN regexp_matches(path, '^src2/fr/[^/]*1[.]txt(/|$)') THEN true
  WHEN path LIKE 'src1/de/%' THEN true
  WHEN path LIKE 'src1/%' THEN false
  ELSE true END AS ignored FROM docs""")
def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).df
    return docs.select("path", P.ignored(docs, P.parse_ignore(IGNORE)).alias("ignored"))


@query(f"""WITH {DOCS} SELECT path, CASE
  WHEN regexp_matches(path, '(^|/)[^/]*7[.]txt(/|$)') THEN false
  WHEN regexp_matches(path, '^src2/fr/[^/]*1[.]txt(/|$)') THEN true
  WHEN path LIKE 'src1/de/%' THEN true
  WHEN path LIKE 'src1/%' THEN false
  ELSE true END AS ignored FROM docs""")
def ignore_rules_join(spark: SparkSession, d: str) -> DataFrame:
    return P.last_rule(corpus(spark, d).df, P.rules_frame(spark, P.parse_ignore(IGNORE)))


@query(f"WITH {DOCS}, v AS (SELECT path || CASE doc_id % 2 WHEN 0 THEN '' ELSE '-x/y' END AS path FROM docs) SELECT path, row_number() OVER (ORDER BY translate(path, '/', chr(1))) AS place FROM v")
def path_sort(spark: SparkSession, d: str) -> DataFrame:
    """Component order: a slash ranks below all else."""
    v = corpus(spark, d).df.select(F.concat("path", F.when(F.col("doc_id") % 2 == 0, "").otherwise("-x/y")).alias("path"))
    return global_rank(v, [P.path_order(F.col("path"))], "place").select("path", (F.col("place") + 1).alias("place"))


# sinks


@query(f"WITH {LINES} SELECT path || ':' || line_number || ':' || line AS value FROM lines WHERE regexp_matches(line, '[0-9]{{4}}')")
def text_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.text_rows(search.matching_lines(corpus(spark, d), YEAR))


@query(f"""WITH {LINES}, m AS (SELECT path, line_number, line, string_split_regex(line, '[0-9]{{4}}') AS g FROM lines WHERE regexp_matches(line, '[0-9]{{4}}'))
SELECT path || ':' || line_number || ':' || CAST(list_sum(list_transform(g[1:k], lambda x: strlen(x))) + 4 * (k - 1) + 1 AS BIGINT) || ':' || line AS value
FROM m, LATERAL (SELECT unnest(generate_series(1, len(g) - 1)) AS k)""")
def vimgrep_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.vimgrep(corpus(spark, d), YEAR)


@query(f"""WITH {LINES}, m AS (SELECT path, line_number, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM lines),
h AS (SELECT *, regexp_extract_all(line, '[0-9]{{4}}') AS found, string_split_regex(line, '[0-9]{{4}}')[1] AS gap FROM m WHERE regexp_matches(line, '[0-9]{{4}}'))
SELECT path, line_number AS ordinal, 'match' AS kind, line || chr(10) AS text, CAST(place AS BIGINT) AS place, CAST(len(found) AS BIGINT) AS matches, CAST(strlen(gap) AS BIGINT) AS first_start, found[1] AS first_match FROM h
UNION ALL SELECT path, 0, 'begin', NULL, NULL, NULL, NULL, NULL FROM h GROUP BY path
UNION ALL SELECT path, 4611686018427387904, 'end', NULL, NULL, CAST(sum(len(found)) AS BIGINT), NULL, NULL FROM h GROUP BY path
UNION ALL SELECT NULL, 4611686018427387905, 'summary', NULL, NULL, CAST(coalesce(sum(len(found)), 0) AS BIGINT), NULL, NULL FROM h""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    of = lambda path: F.get_json_object("record", path)
    spans = F.from_json(of("$.data.submatches"), "array<struct<match:struct<text:string>,start:int,end:int>>")
    rows = sinks.json_records(corpus(spark, d), YEAR)
    return rows.select(
        "path", "ordinal", of("$.type").alias("kind"), of("$.data.lines.text").alias("text"), of("$.data.absolute_offset").cast("long").alias("place"),
        F.coalesce(of("$.data.stats.matches").cast("long"), F.when(spans.isNotNull(), F.size(spans)).cast("long")).alias("matches"),
        spans[0]["start"].cast("long").alias("first_start"), spans[0]["match"]["text"].alias("first_match"),
    )


@query(f"""WITH {LINES}, m AS (SELECT path, line_number, line FROM lines WHERE regexp_matches(line, '[0-9]{{4}}'))
SELECT path, line_number * 2 + 1 AS ordinal, line_number || ':' || line AS value FROM m UNION ALL SELECT DISTINCT path, 0, path FROM m""")
def headed_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.headed(search.matching_lines(corpus(spark, d), YEAR))


@query(f"WITH {LINES} SELECT min(path) AS path FROM lines WHERE contains(line, 'License') AND NOT path LIKE 'src1/%' HAVING min(path) IS NOT NULL")
def witness_outside(spark: SparkSession, d: str) -> DataFrame:
    return search.witness(corpus(spark, d), P.under_root(F.col("path"), "src1"), Pattern("License", fixed=True))


@query("SELECT event_type || '/' || event_id AS path, ts AS mtime, row_number() OVER (ORDER BY ts DESC, event_type || '/' || event_id DESC) AS place FROM events")
def files_by_time(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").select(F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("mtime"))
    ranked = global_rank(files, [F.desc("mtime"), F.desc(P.path_order(F.col("path")))], "place")
    return ranked.select("path", "mtime", (F.col("place") + 1).alias("place"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 50000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sinks.within_budget(docs.select("doc_id", "source", F.octet_length("text").alias("size")), F.col("size"), ["doc_id"], 50_000, "source").select("doc_id", "source")


# class runs


@query("SELECT doc_id, " + ", ".join(f"CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '{c.replace(chr(39), chr(39) * 2)}+'), lambda x: length(x))), 0) AS BIGINT) AS run_{n}" for n, c in (("digit", "[0-9]"), ("hex", "[0-9A-Fa-f]"), ("upper", "[A-Z]"), ("punct", "[!-/:-@\\[-^`{-~]"))) + " FROM documents")
def class_runs(spark: SparkSession, d: str) -> DataFrame:
    names = ["digit", "hex", "upper", "punct"]
    return indexes.with_runs(table(spark, d, "documents"), names).select("doc_id", *[f"run_{n}" for n in names])


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9a-f]{12}|[0-9]{6}')")
def class_run_prune(spark: SparkSession, d: str) -> DataFrame:
    """The persisted runs let few documents through; the pattern then decides."""
    needed, docs = indexes.required_runs("[0-9a-f]{12}|[0-9]{6}"), table(spark, d, "documents")
    some = indexes.stored_runs(docs, d, indexes.run_names(needed)).where(indexes.survives(needed)).select("doc_id")
    return docs.join(some, "doc_id", "left_semi").where(Pattern("[0-9a-f]{12}|[0-9]{6}").matches(F.col("text"))).select("doc_id")


# scalars


@query(f"""WITH {LINES} SELECT path, line_number, regexp_matches(line, '[0-9]+') AS hit, CAST(len(regexp_extract_all(line, '[a-z]+ing')) AS BIGINT) AS n, regexp_extract(line, '[0-9]+') AS first,
  CAST(len(string_split_regex(line, '[,;]')) AS BIGINT) AS pieces, regexp_replace(line, '[aeiou]', '_', 'g') AS masked, regexp_replace(line, '[0-9]+', '#') AS once FROM lines""")
def regex_scalars(spark: SparkSession, d: str) -> DataFrame:
    """is_match, count, find, split, replace all and replace first."""
    line = F.col("line")
    once = F.regexp_replace(line, r"(?s)\A(.*?)[0-9]+(.*)\z", "$1#$2")
    return corpus(spark, d).lines().select(
        "path", "line_number", F.rlike(line, F.lit("[0-9]+")).alias("hit"), F.regexp_count(line, F.lit("[a-z]+ing")).cast("long").alias("n"), F.regexp_extract(line, "[0-9]+", 0).alias("first"),
        F.size(F.split(line, "[,;]", -1)).cast("long").alias("pieces"), F.regexp_replace(line, "[aeiou]", "_").alias("masked"), once.alias("once"),
    )


@query(f"WITH {LINES} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, '^\\s*(//|#|/\\*|\\*|\\\\\\\\)') GROUP BY path")
def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.lexing import comment_only

    return corpus(spark, d).lines().where(comment_only(F.col("line"))).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


SPACE = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(f"""WITH {LINES}, w AS (SELECT path, line_number, string_split_regex(line, '{SPACE}') AS p FROM lines),
n AS (SELECT path, line_number, p, unnest(generate_series(2, len(p) - 2)) AS i FROM w)
SELECT DISTINCT path, line_number FROM n WHERE p[i] = p[i + 1] AND regexp_full_match(p[i], '[a-z]+')""")
def lookaround_lines(spark: SparkSession, d: str) -> DataFrame:
    """Backtracking patterns are run only where they are allowed."""
    p = Pattern(r"(?<=\s)([a-z]+)\s\1(?=\s)", backtracking=True)
    return search.matching_lines(corpus(spark, d), p).select("path", "line_number")


@query("SELECT doc_id, regexp_matches(text, '[b-df-hj-np-tv-z]{5}') AS consonants, regexp_matches(text, '[[:punct:]]{3}') AS marks FROM documents")
def class_algebra(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", Pattern("[a-z--[aeiou]]{5}").matches(text).alias("consonants"), Pattern("[[:punct:]]{3}").matches(text).alias("marks"))
