"""Queries of pattern sets, joins, windows, indexes, substrings, ranking, graphs, kinship and freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus, line_grid
from ..functions.patterns import Pattern
from ..operators import graphs, indexes, kinship, lexing, ranking, snapshots, substrings
from ..operators.patternsets import Needles, PatternSet, RowPlan, from_table, pattern_ends
from ..streaming.fresh import latest
from .registry import DOCS, LINES, corpus, query, table

PATTERNS = PatternSet(
    {
        "year": Pattern("[0-9]{4}"),
        "hex": Pattern("[0-9a-f]{12}"),
        "license": Pattern("license", fixed=True, ignore_case=True),
        "mail": Pattern(r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+"),
        "the": Pattern("the ", fixed=True),
        "none": Pattern("zzzzqq", fixed=True),
    }
)
HITS = (
    LINES
    + """, hits AS (
  SELECT path, line_number AS line, CAST(0 AS BIGINT) AS pattern_id, doc_id FROM lines WHERE regexp_matches(line, '[0-9]{4}')
  UNION ALL SELECT path, line_number, 1, doc_id FROM lines WHERE regexp_matches(line, '[0-9a-f]{12}')
  UNION ALL SELECT path, line_number, 2, doc_id FROM lines WHERE regexp_matches(line, '(?i)license')
  UNION ALL SELECT path, line_number, 3, doc_id FROM lines WHERE regexp_matches(line, '[A-Za-z0-9_.]+@[A-Za-z0-9_.]+')
  UNION ALL SELECT path, line_number, 4, doc_id FROM lines WHERE contains(line, 'the '))"""
)
LABEL = "CASE pattern_id WHEN 0 THEN 'year' WHEN 1 THEN 'hex' WHEN 2 THEN 'license' WHEN 3 THEN 'mail' ELSE 'the' END"


@query(f"WITH {HITS} SELECT path, line, pattern_id FROM hits")
def pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    return PATTERNS.line_hits(corpus(spark, d))


@query(f"WITH {HITS} SELECT {LABEL} AS label, count(*) AS \"count\" FROM hits WHERE regexp_matches(path, '^src[0-9]*/') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """Filter by glob, group by pattern, sort by count and label, limit."""
    return RowPlan(PATTERNS, glob="src*/**", group="pattern", limit=4).run(PATTERNS.line_hits(corpus(spark, d)))


@query(f'WITH {HITS} SELECT path AS label, count(*) AS "count" FROM hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25')
def pattern_counts_by_file(spark: SparkSession, d: str) -> DataFrame:
    return RowPlan(PATTERNS, group="file", limit=25).run(PATTERNS.line_hits(corpus(spark, d)))


@query(f'WITH {HITS} SELECT {LABEL} AS label, count(*) AS "count" FROM hits GROUP BY 1')
def pattern_counts_by_label(spark: SparkSession, d: str) -> DataFrame:
    return RowPlan(PATTERNS, group="pattern", order="label").run(PATTERNS.line_hits(corpus(spark, d)))


@query(f"WITH {HITS} SELECT path, line, pattern_id FROM hits ORDER BY path, line, pattern_id LIMIT 100")
def sorted_hits(spark: SparkSession, d: str) -> DataFrame:
    return RowPlan(PATTERNS, limit=100).run(PATTERNS.line_hits(corpus(spark, d)))


@query(f"WITH {HITS} SELECT path, string_agg(DISTINCT CAST(pattern_id AS VARCHAR), ',' ORDER BY CAST(pattern_id AS VARCHAR)) AS patterns FROM hits GROUP BY path")
def document_masks(spark: SparkSession, d: str) -> DataFrame:
    found = PATTERNS.document_mask(corpus(spark, d))
    return found.select("path", F.array_join(F.col("patterns").cast("array<string>"), ",").alias("patterns"))


@query(f"WITH {DOCS} SELECT path, regexp_matches(text, 'a\\s[A-Z]') AS crosses FROM docs WHERE regexp_matches(text, 'a\\s[A-Z]') OR regexp_matches(text, '[0-9]\\n')")
def buffer_masks(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that may cross lines."""
    both = PatternSet({"a": Pattern(r"a[\t-\r ][A-Z]"), "b": Pattern("[0-9]\\n")})
    return both.buffer_mask(corpus(spark, d)).select("path", F.array_contains("patterns", 0).alias("crosses"))


NEEDLES = Needles(["the", "ethe", "anan", "License"])


@query(f"WITH {DOCS} SELECT doc_id, contains(text, 'the') AS a, contains(text, 'ethe') AS b, contains(text, 'anan') AS c, contains(text, 'License') AS d FROM docs")
def needles_which(spark: SparkSession, d: str) -> DataFrame:
    found = NEEDLES.which(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[F.array_contains(found, i).alias(n) for i, n in enumerate("abcd")])


def _places(needle: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos FROM documents, LATERAL (SELECT unnest(generate_series(1, length(text) - {len(needle) - 1})) AS i) WHERE contains(text, '{needle}') AND substr(text, i, {len(needle)}) = '{needle}'"


@query(f"SELECT doc_id, CAST(k AS BIGINT) AS needle_id, pos AS start, pos + n AS \"end\" FROM (SELECT *, 0 AS k, 4 AS n FROM ({_places('anan')}) UNION ALL SELECT *, 1, 3 FROM ({_places('www')}))")
def needle_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence, overlapping ones included."""
    return Needles(["anan", "www"]).occurrences(table(spark, d, "documents"))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line, unnest(generate_series(1, length(line) - 1)) AS i FROM lines WHERE contains(line, 'th') OR contains(line, 'an')),
e AS (SELECT doc_id, 0 AS pattern_id, i + 1 AS "end" FROM c WHERE substr(line, i, 2) = 'th' UNION ALL SELECT doc_id, 0, i + 2 FROM c WHERE regexp_full_match(substr(line, i, 3), 'th[a-z]')
  UNION ALL SELECT doc_id, 1, i + 1 FROM c WHERE substr(line, i, 2) = 'an')
SELECT doc_id, CAST(pattern_id AS BIGINT) AS pattern_id, count(*) AS n, CAST(sum("end") AS BIGINT) AS ends FROM e GROUP BY doc_id, pattern_id""")
def match_ends(spark: SparkSession, d: str) -> DataFrame:
    """All ends of all matches on the documents' lines, added up by document."""
    found = pattern_ends(corpus(spark, d).lines(), {"th": "th[a-z]?", "an": "an(?:an)*"})
    return found.groupBy("doc_id", "pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("ends"))


@query(f"WITH {DOCS} SELECT d.doc_id, p.pattern_id FROM docs d, (VALUES (0, '[0-9]{{4}}'), (1, 'the of'), (2, 'zz')) p(pattern_id, pattern) WHERE regexp_matches(d.text, p.pattern)")
def patterns_by_join(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame([(0, "[0-9]{4}"), (1, "the of"), (2, "zz")], "pattern_id int, pattern string")
    return from_table(corpus(spark, d).df, patterns).select("doc_id", "pattern_id")


# joins


@query(f"WITH {DOCS}, wanted AS (SELECT DISTINCT 'src' || event_id % 20 || '/' || CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'fr' END || '/' || event_id || '.txt' AS path FROM events) SELECT path, CAST(length(text) AS BIGINT) AS n FROM docs JOIN wanted USING (path)")
def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The documents among many paths asked for, of which most are not there."""
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "es", "fr")]), (F.col("event_id") % 4 + 1).cast("int"))
    wanted = table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string"), F.lit("/"), lang, F.lit("/"), F.col("event_id").cast("string"), F.lit(".txt")).alias("path")).distinct()
    return corpus(spark, d).df.join(wanted, "path", "left_semi").select("path", F.length("text").cast("long").alias("n"))


@query("""WITH s AS (SELECT doc_id, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS n FROM documents)
SELECT doc_id, start, start + n AS stop FROM s""")
def shelf_offsets(spark: SparkSession, d: str) -> DataFrame:
    return substrings.shelf(table(spark, d, "documents"))


@query("""WITH s AS (SELECT doc_id, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS n FROM documents),
p AS (SELECT CAST(event_id * 37 AS BIGINT) AS pos FROM events WHERE event_id * 37 <= (SELECT max(start + n) FROM s))
SELECT pos, doc_id, pos - start AS "offset" FROM p JOIN s ON pos BETWEEN start AND start + n""")
def position_to_document(spark: SparkSession, d: str) -> DataFrame:
    catalog = substrings.shelf(table(spark, d, "documents"))
    end = catalog.agg(F.max("stop").alias("end"))
    places = table(spark, d, "events").select((F.col("event_id") * 37).cast("long").alias("pos"))
    places = places.join(F.broadcast(end), F.col("pos") <= F.col("end")).select("pos")  # one row
    return substrings.document_at(places, catalog)


@query(f"""WITH {LINES} SELECT doc_id, line_number, CAST(coalesce(sum(strlen(line) + 1) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(strlen(line) + 1) OVER w, 0) + strlen(line) AS BIGINT) AS content_end
FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return line_grid(corpus(spark, d).lines()).select("doc_id", "line_number", "start", "content_end")


@query(f"""WITH {LINES}, g AS (SELECT doc_id, line_number, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, strlen(line) AS n FROM lines)
SELECT doc_id, CAST(o AS BIGINT) AS "offset", line_number FROM g, (VALUES (0), (100), (1000), (5000)) v(o) WHERE o BETWEEN start AND start + n""")
def offset_to_line(spark: SparkSession, d: str) -> DataFrame:
    grid = line_grid(corpus(spark, d).lines())
    # a handful of constants: an interval test on each line's own row
    asked = F.filter(F.array(*[F.lit(x).cast("long") for x in (0, 100, 1000, 5000)]), lambda o: (o >= F.col("start")) & (o < F.col("term_end")))
    return grid.select("doc_id", F.explode(asked).alias("offset"), "line_number")


@query("SELECT a.doc_id, min(b.doc_id) AS canonical FROM documents a JOIN documents b ON a.text = b.text AND b.doc_id < a.doc_id GROUP BY a.doc_id")
def duplicate_canonical(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.canonical_of_mirrors(corpus(spark, d))
    return found.where("canonical < doc_id")


@query("SELECT md5(text) AS digest, CAST(length(text) AS BIGINT) AS size, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("size"))
    return rows.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


# windows and aggregates


@query("SELECT doc_id, CAST(ntile(16) OVER (ORDER BY doc_id) AS BIGINT) AS shard FROM documents")
def balanced_bounds(spark: SparkSession, d: str) -> DataFrame:
    return substrings.balanced_bounds(table(spark, d, "documents").select("doc_id"), ["doc_id"], 16)


@query("SELECT l_orderkey, CAST(min(l_quantity) AS DOUBLE) AS tropical, max(l_quantity) AS viterbi, count(*) AS counting, bool_or(l_returnflag = 'R') AS reached FROM lineitem GROUP BY l_orderkey")
def semiring_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        graphs.TROPICAL.add(F.col("l_quantity")).alias("tropical"), graphs.VITERBI.add(F.col("l_quantity")).alias("viterbi"), graphs.COUNTING.add(F.lit(1).cast("long")).alias("counting"), graphs.BOOLEAN.add(F.col("l_returnflag") == "R").alias("reached")
    )


@query(f"""WITH {LINES}, s AS (SELECT path, line_number, regexp_replace(regexp_replace(line, '[A-Za-z]+', 'I', 'g'), '[0-9]+', 'N', 'g') AS shape FROM lines WHERE regexp_matches(line, '[0-9]{{4}}'))
SELECT path, line_number, count(*) OVER (PARTITION BY shape) AS df, round(log2((SELECT count(*) FROM s) / count(*) OVER (PARTITION BY shape)), 9) AS bits FROM s""")
def shape_frequency(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus(spark, d).lines().where(F.rlike("line", F.lit("[0-9]{4}")))
    shaped = lines.select("path", "line_number", F.regexp_replace(F.regexp_replace("line", "[A-Za-z]+", "I"), "[0-9]+", "N").alias("shape"))
    counts = shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("df"))
    total = counts.agg(F.sum("df").alias("total"))
    joined = shaped.join(counts, "shape").crossJoin(F.broadcast(total))  # one row
    return joined.select("path", "line_number", "df", F.round(F.log2(F.col("total") / F.col("df")), 9).alias("bits"))


@query(f"WITH {LINES} SELECT path, arg_min(line_number, (CASE WHEN regexp_matches(line, '^[A-Z]') THEN 0 ELSE 1 END, line_number)) AS line_number, count(*) AS n FROM lines WHERE regexp_matches(line, '[0-9]{{4}}') GROUP BY path")
def best_lines(spark: SparkSession, d: str) -> DataFrame:
    """Of each file the first matching line that opens a statement, else the first one."""
    lines = corpus(spark, d).lines().where(F.rlike("line", F.lit("[0-9]{4}")))
    order = F.struct(F.when(F.rlike("line", F.lit("^[A-Z]")), 0).otherwise(1), F.col("line_number"))
    return lines.groupBy("path").agg(F.min_by("line_number", order).alias("line_number"), F.count(F.lit(1)).alias("n"))


# indexes

GRAMS = "grams AS (SELECT DISTINCT doc_id, substr(text, CAST(i AS BIGINT), 3) AS trigram FROM documents, LATERAL (SELECT unnest(generate_series(1, length(text) - 2)) AS i))"


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """The persisted index of the documents: built by the first query that needs it."""
    return indexes.stored_postings(table(spark, d, "documents"), d)


@query(f"WITH {GRAMS} SELECT count(*) AS postings, count(DISTINCT trigram) AS trigrams, count(DISTINCT doc_id) AS documents FROM grams")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """What the persisted index holds."""
    per = _postings(spark, d).groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))
    documents = _postings(spark, d).select("doc_id").distinct().agg(F.count(F.lit(1)).alias("documents"))
    return per.agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("trigrams")).crossJoin(documents)  # one row each


@query(f"WITH {GRAMS} SELECT trigram, count(*) AS df FROM grams GROUP BY trigram")
def trigram_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return indexes.frequencies(_postings(spark, d))


@query(f"WITH {GRAMS} SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id")
def document_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(indexes.distinct_trigrams(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query(f"WITH {GRAMS} SELECT doc_id FROM grams WHERE trigram IN ('Lic', 'ice', 'cen', 'ens', 'nse') GROUP BY doc_id HAVING count(*) = 5")
def trigram_candidates(spark: SparkSession, d: str) -> DataFrame:
    return indexes.candidates_literal(_postings(spark, d), "License")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def trigram_verified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = indexes.candidates_literal(_postings(spark, d), "License")
    return indexes.verify(docs, found, Pattern("License", fixed=True)).select("doc_id")


@query(f"""WITH {GRAMS}, g AS (SELECT doc_id, bool_or(trigram = 'Lic') AS a, bool_or(trigram = 'ice') AS b, bool_or(trigram = 'GNU') AS c, bool_or(trigram = 'ver') AS e FROM grams GROUP BY doc_id)
SELECT doc_id FROM g WHERE ((a AND b) OR c) AND e""")
def boolean_plan_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _postings(spark, d)
    return indexes.candidates_cnf(rows, [[["Lic", "ice"], ["GNU"]], [["ver"]]])


@query("SELECT doc_id FROM documents WHERE contains(text, 'qz') OR contains(text, '@') OR length(text) < 3")
def short_needle_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = _postings(spark, d)
    narrowed = indexes.candidates_short(rows, docs, "qz").union(indexes.candidates_short(rows, docs, "@")).distinct()
    kept = docs.join(narrowed, "doc_id", "left_semi")
    return kept.where(F.contains("text", F.lit("qz")) | F.contains("text", F.lit("@")) | (F.length("text") < 3)).select("doc_id")


#: Documents labelled toxic are deleted, those of low quality are replaced.
AMENDED = """amended AS (SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'License ' || d.doc_id ELSE d.text END AS text
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0)"""


def _amendment(spark: SparkSession, d: str) -> tuple[DataFrame, indexes.Amendment]:
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    changed = docs.join(labels.where("quality = 0 and toxic = 0"), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("License "), F.col("doc_id").cast("string")))
    return docs, indexes.Amendment(changed, labels.where("toxic = 1").select("doc_id"))


@query(f"WITH {AMENDED}, grams AS (SELECT DISTINCT doc_id, substr(text, CAST(i AS BIGINT), 3) AS trigram FROM amended, LATERAL (SELECT unnest(generate_series(1, length(text) - 2)) AS i)) SELECT trigram, count(*) AS df FROM grams GROUP BY trigram")
def amended_index(spark: SparkSession, d: str) -> DataFrame:
    docs, amendment = _amendment(spark, d)
    return indexes.frequencies(amendment.apply(indexes.postings(docs)))


@query(f"WITH {AMENDED} SELECT doc_id FROM amended WHERE contains(text, 'License')")
def overlay_search(spark: SparkSession, d: str) -> DataFrame:
    docs, amendment = _amendment(spark, d)
    return amendment.overlay(docs).where(F.contains("text", F.lit("License"))).select("doc_id")


@query("SELECT event_id AS doc_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'")
def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    files = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("mtime"))
    return indexes.changed(files, datetime.datetime(2024, 1, 25)).select("doc_id")


@query("SELECT event_id AS doc_id FROM events WHERE event_type = 'error' OR ts >= TIMESTAMP '2024-01-28 00:00:00'")
def fresh_candidates(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    files = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("mtime"), "event_type")
    return indexes.fresh_candidates(files.where("event_type = 'error'"), indexes.changed(files, datetime.datetime(2024, 1, 28)))


@query(f"WITH {DOCS} SELECT doc_id, path, CAST(strlen(text) AS BIGINT) AS size FROM docs WHERE contains(text, 'License') ORDER BY size, doc_id")
def reading_list(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d).df
    return indexes.reading_list(c, c.where(F.contains("text", F.lit("License"))).select("doc_id"))


@query("SELECT user_id AS doc_id, max(ts) AS mtime, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def last_changes(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of each key, as a stream's batch is merged."""
    changes = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("mtime"), F.col("event_id").alias("deleted"), F.lit("").alias("text"))
    return latest(changes).select("doc_id", "mtime", F.col("deleted").alias("event_id"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.fresh import windowed_counts

    return windowed_counts(table(spark, d, "events"))


# substrings


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM ({_places('anan')})")
def substring_count(spark: SparkSession, d: str) -> DataFrame:
    return substrings.count(table(spark, d, "documents"), "anan")


@query(_places("anan"))
def substring_locate(spark: SparkSession, d: str) -> DataFrame:
    return substrings.locate(table(spark, d, "documents"), "anan")


@query(f"SELECT doc_id, count(*) AS n FROM ({_places('theth')}) GROUP BY doc_id")
def substring_tally(spark: SparkSession, d: str) -> DataFrame:
    return substrings.tally(table(spark, d, "documents"), "theth")


@query("SELECT doc_id, substr(text, 11, 20) AS piece FROM documents")
def substring_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", substrings.extract(F.col("text"), 10, 20).alias("piece"))


# ranking

FEATURES = f"""{LINES}, m AS (SELECT doc_id, path, line_number, line FROM lines WHERE contains(line, 'the')),
f AS (SELECT doc_id, path, count(*) AS matches, min(line_number) AS best_line, CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth FROM m GROUP BY doc_id, path)"""


@query(f"""WITH {FEATURES}, s AS (SELECT doc_id, matches % 3 AS shape, * EXCLUDE (doc_id) FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY matches DESC, best_line, doc_id) - 1 AS lx, row_number() OVER (ORDER BY depth, best_line, doc_id) - 1 AS sh,
  count(*) FILTER (shape <> 0) OVER () AS shaped, count(*) OVER (PARTITION BY shape) AS alike FROM s)
SELECT doc_id, round(1.0 / (60 + lx) + 0.25 / (60 + sh) + CASE WHEN shape <> 0 AND shaped > 1 THEN 0.75 / 60 * log2(shaped / alike) / log2(shaped) ELSE 0 END + 3.0 / 60
  + CASE WHEN best_line = 1 THEN 2.0 / 60 ELSE 0 END + coalesce(1.0 / (60 + l.doc_id), 0), 9) AS score FROM r LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)""")
def fused_ranks(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus(spark, d).lines().where(F.contains("line", F.lit("the")))
    from ..functions.paths import depth

    features = lines.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("matches"), F.min("line_number").alias("best_line")).select(
        "doc_id", "matches", "best_line", depth(F.col("path")).alias("depth"), F.when(F.col("best_line") == 1, 3).otherwise(0).alias("definition"), (F.col("matches") % 3).alias("shape"),
        F.lit(False).alias("is_generated"), F.lit(False).alias("is_mirror"),
    )
    external = table(spark, d, "labels").where("quality = 1").select("doc_id", F.col("doc_id").alias("position"))
    return ranking.fuse(features, external=external).select("doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH {FEATURES}, r AS (SELECT path, doc_id, best_line, matches, row_number() OVER (ORDER BY matches DESC, best_line, doc_id) - 1 AS lx, row_number() OVER (ORDER BY depth, best_line, doc_id) - 1 AS sh FROM f)
SELECT path, matches AS "count", best_line AS line_number FROM r ORDER BY 1.0 / (60 + lx) + 0.25 / (60 + sh) DESC, doc_id LIMIT 20""")
def top_documents(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty, by lexical and shallow orders."""
    lines = corpus(spark, d).lines().where(F.contains("line", F.lit("the")))
    from ..functions.paths import depth

    features = lines.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("matches"), F.min("line_number").alias("best_line")).select(
        "doc_id", "path", "matches", "best_line", depth(F.col("path")).alias("depth"), F.lit(0).alias("definition"), F.lit(0).alias("shape"), F.lit(False).alias("is_generated"), F.lit(False).alias("is_mirror")
    )
    return ranking.top(ranking.fuse(features, ranking.Weights(authored=0.0))).select("path", F.col("matches").alias("count"), F.col("best_line").alias("line_number"))


@query(None)
def ranked_view(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked_view(corpus(spark, d), Pattern("the", fixed=True), "the").select("path", "line_number", "kind", "count", "snippet")


# graphs



@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, -c_nationkey - 1 AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT node, min(seen) AS label FROM r GROUP BY node""")
def connected_families(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (-F.col("c_nationkey") - 1).cast("long").alias("b"))
    return graphs.components(edges)


HOPS = "SELECT DISTINCT n.n_nationkey AS src, s.n_nationkey AS dst, CAST(1 + abs(n.n_nationkey - s.n_nationkey) % 3 AS DOUBLE) AS weight FROM nation n JOIN nation s ON (n.n_nationkey * 7 + 3) % 25 = s.n_nationkey OR (n.n_nationkey + 1) % 25 = s.n_nationkey"


def _hops(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    both = F.explode(F.array_distinct(F.array((F.col("src") * 7 + 3) % 25, (F.col("src") + 1) % 25))).alias("dst")
    return keys.select("src", both).withColumn("weight", (1 + F.abs(F.col("src") - F.col("dst")) % 3).cast("double"))


@query(f"""WITH RECURSIVE e AS ({HOPS}), r(node, value, n) AS (SELECT 0, CAST(0 AS DOUBLE), 0 UNION SELECT e.dst, r.value + e.weight, r.n + 1 FROM r JOIN e ON r.node = e.src WHERE r.n < 9 AND r.value < 16)
SELECT node, min(value) AS value FROM r GROUP BY node""")
def shortest_distances(spark: SparkSession, d: str) -> DataFrame:
    return graphs.distances(_hops(spark, d), 0)


@query(f"WITH RECURSIVE e AS ({HOPS}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst, true AS weight FROM r")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return graphs.closure(_hops(spark, d).select("src", "dst", F.lit(True).alias("weight")))


# lexing and kinship


TOKENS = "[A-Za-z]+|[0-9]+[.][0-9]+|[0-9]+|[ \\t\\n]+|[^ \\t\\nA-Za-z0-9]"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?s){TOKENS}') AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS token, unnest(generate_series(1, len(x))) AS i FROM t),
v AS (SELECT doc_id, token, coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, CAST(CASE WHEN regexp_matches(token, '^[A-Za-z]') THEN 0 WHEN regexp_full_match(token, '[0-9]+') THEN 1 WHEN regexp_matches(token, '^[0-9]') THEN 2 WHEN regexp_matches(token, '^[ \t\n]') THEN 3 ELSE 4 END AS BIGINT) AS rule,
  count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(length(token)) AS BIGINT) AS size FROM v GROUP BY 1, 2""")
def longest_match_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of all documents, added up by rule."""
    rules = lexing.Rules((r"[A-Za-z]+", r"[0-9]+", r"[0-9]+\.[0-9]+", r"[ \t\n]+", r"[^ \t\nA-Za-z0-9]"))
    found = lexing.tokens(table(spark, d, "documents"), rules, spelled=False)
    return found.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("size"))


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[a-z]*th[a-z]*') AS m, string_split_regex(text, '[a-z]*th[a-z]*') AS g FROM documents),
u AS (SELECT doc_id, unnest(m) AS match, unnest(list_slice(g, 1, len(m))) AS gap, unnest(generate_series(1, len(m))) AS i FROM s WHERE len(m) > 0),
v AS (SELECT doc_id, match, sum(strlen(gap) + strlen(match)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM u)
SELECT doc_id, CAST(e - strlen(match) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", match FROM v""")
def byte_spans(spark: SparkSession, d: str) -> DataFrame:
    return lexing.spans(table(spark, d, "documents"), "[a-z]*th[a-z]*", text="text", keep=("doc_id",))


def _sketches(spark: SparkSession, d: str, with_structure: bool = False) -> DataFrame:
    from ..storage import materialize

    return materialize(kinship.sketches(corpus(spark, d).df, with_structure), "sketches")


@query(None)
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return kinship.dup_pairs(_sketches(spark, d))


@query(None)
def kinship_echoes(spark: SparkSession, d: str) -> DataFrame:
    return kinship.echoes(_sketches(spark, d, with_structure=True))


@query(None)
def likeness_clusters(spark: SparkSession, d: str) -> DataFrame:
    return kinship.clusters(_sketches(spark, d)).select(F.array_join("paths", ",").alias("paths"), "max_distance", "grade")


@query(None)
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    known = _sketches(spark, d)
    return kinship.similar(known, known.orderBy("path"))


def _asked(spark: SparkSession, d: str) -> list[tuple]:
    """The stated queries of the coding searches: the benchmark items whose ids are divisible by 50."""
    items = table(spark, d, "benchmark").where("item_id % 50 = 0 and text is not null").select("item_id", "text")
    return [(r["item_id"], r["text"]) for r in items.orderBy("item_id").toLocalIterator()]


@query(None)
def recalled_documents(spark: SparkSession, d: str) -> DataFrame:
    """What each query item costs given each document."""
    docs = corpus(spark, d).df
    parts = [kinship.recall(docs, text).select(F.lit(item).alias("item_id"), "*") for item, text in _asked(spark, d)]
    return reduce(DataFrame.unionByName, parts)


@query(None)
def quoted_phrases(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).df
    parts = [kinship.quote(docs, text, least=8).select(F.lit(item).alias("item_id"), "*") for item, text in _asked(spark, d)]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {LINES}, w AS (SELECT DISTINCT path, line_number, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS symbol FROM lines)
SELECT symbol, count(*) AS lines, count(DISTINCT path) AS files FROM w GROUP BY symbol""")
def symbol_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = kinship.mentions(corpus(spark, d).lines())
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("path").alias("files"))


@query(f"WITH {LINES} SELECT path, line_number, length(line) AS n FROM lines WHERE regexp_matches(line, '^[A-Z]') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hits of documents that another table classifies."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    lines = corpus(spark, d).lines().where(F.rlike("line", F.lit("^[A-Z]"))).join(good, "doc_id", "left_semi")
    return lines.select("path", "line_number", F.length("line").cast("long").alias("n"))


# planned searches and functions


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(GNU|MIT) (General|License)[a-z ]*[A-Z]')")
def planned_search(spark: SparkSession, d: str) -> DataFrame:
    """The index and the guard narrow, the pattern decides."""
    from . import prefilter

    docs = table(spark, d, "documents")
    return prefilter.search(docs, Pattern("(GNU|MIT) (General|License)[a-z ]*[A-Z]"), postings=_postings(spark, d)).select("doc_id")


TRICKY = (r"\<the\>", "[[:punct:]]{3}", "[a[bc]]x", r"\b{start}the", "[a-z--[aeiou]]{5}", r"\[0-9]{2}", r"\d{5}", "(?i:LICENSE)", "Licen[cs]e|GNU")


@query(r"""SELECT doc_id, n AS pattern FROM documents, (VALUES (0, '\bthe\b'), (1, '[[:punct:]]{3}'), (2, '[abc]x'), (3, '\bthe'), (4, '[b-df-hj-np-tv-z]{5}'), (5, '\[0-9\]{2}'), (6, '[0-9]{5}'), (7, '(?i)license'),
(8, 'Licen[cs]e|GNU')) p(n, re) WHERE CASE WHEN n = 0 THEN regexp_matches(text, '(^|[^\pL\pM\p{Nd}\p{Pc}])the([^\pL\pM\p{Nd}\p{Pc}]|$)') WHEN n = 3 THEN regexp_matches(text, '(^|[^\pL\pM\p{Nd}\p{Pc}])the') ELSE regexp_matches(text, re) END""")
def planned_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns whose spelling is easily misread, each through the index, the runs and the guard."""
    from . import prefilter

    names = indexes.run_names([alternative for text in TRICKY for alternative in indexes.required_runs(text)])
    docs = table(spark, d, "documents").join(indexes.stored_runs(table(spark, d, "documents"), d, names), "doc_id")
    out = None
    for n, text in enumerate(TRICKY):
        part = prefilter.search(docs, Pattern(text), postings=_postings(spark, d), runs=True).select("doc_id", F.lit(n).alias("pattern"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT * FROM (VALUES ('License', 7, 7, false, false, false, 'License'), ('(GNU|MIT) [A-Z]+', 5, NULL, false, false, false, 'GNU |MIT '), ('[0-9]{4}', 4, 4, false, false, false, ''),
('a*', 0, NULL, true, false, false, ''), ('^the (cat|dog)s?$', 7, 8, false, true, true, 'the cat|the dog')) t(pattern, "least", "most", nullable, anchored_start, anchored_end, required)""")
def pattern_facts(spark: SparkSession, d: str) -> DataFrame:
    """What matches of some patterns must contain."""
    from . import prefilter

    rows = []
    for p in ("License", "(GNU|MIT) [A-Z]+", "[0-9]{4}", "a*", "^the (cat|dog)s?$"):
        f = prefilter.facts(p)
        rows.append((p, f.least, f.most, f.nullable, f.anchored_start, f.anchored_end, " & ".join("|".join(sorted(c)) for c in f.clauses())))
    return spark.createDataFrame(rows, "pattern string, least int, most int, nullable boolean, anchored_start boolean, anchored_end boolean, required string")


@query("""SELECT item_id, regexp_extract(text, '[A-Z][a-z]+') AS first, regexp_matches(text, '^(?s:.)*[.]$') AS whole, CAST(len(regexp_extract_all(text, 'th[a-z]*')) AS BIGINT) AS n,
  CAST(len(string_split_regex(text, '[.,] ')) AS BIGINT) AS pieces, regexp_replace(text, '(th)([a-z]+)', '\\2\\1', 'g') AS swapped, regexp_replace(text, 'the', '<$1>') AS once FROM benchmark""")
def regex_functions(spark: SparkSession, d: str) -> DataFrame:
    """search, fullmatch, findall, split and sub as columns."""
    from ..functions import matching as M

    text = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id", M.search(text, Pattern("[A-Z][a-z]+")).alias("first"), M.fullmatch(text, Pattern("(?s:.)*[.]")).alias("whole"), M.count(text, Pattern("th[a-z]*")).alias("n"),
        F.size(M.split(text, Pattern("[.,] "))).cast("long").alias("pieces"), M.sub(text, Pattern("(th)([a-z]+)"), "$2$1", ("", "")).alias("swapped"), M.sub_first(text, Pattern("the"), "<$1>").alias("once"),
    )


@query("SELECT o_orderkey, CAST(bit_count(o_custkey * 2654435761) AS BIGINT) AS ones, CAST(bit_count((o_custkey * 2654435761) & 65535) AS BIGINT) AS below FROM orders")
def bit_ranks(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import succinct

    bits = F.col("o_custkey") * F.lit(2654435761)
    return table(spark, d, "orders").select("o_orderkey", succinct.popcount(bits).alias("ones"), succinct.rank(bits, 16).alias("below"))


@query("SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE -1 END AS BIGINT) AS place FROM events")
def word_ranks(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import succinct

    return table(spark, d, "events").select("event_id", succinct.WordSet.of(["view", "click", "error"]).rank(F.col("event_type")).alias("place")).fillna(-1, ["place"])


@query(f"""WITH {LINES}, w AS (SELECT path, regexp_extract_all(line, '(?:^|\\s)(?:def|fn|func|function|class|struct|enum|trait|interface|type|const)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS defined,
  unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))) AS symbol FROM lines), k AS (SELECT path, symbol, list_contains(defined, symbol) AS defines FROM w),
uses AS (SELECT DISTINCT symbol, path FROM k WHERE NOT defines), defs AS (SELECT DISTINCT symbol, path FROM k WHERE defines), one AS (SELECT path FROM uses WHERE symbol = 'License'),
two AS (SELECT u.path, min(u.symbol) AS via FROM one JOIN defs d ON one.path = d.path JOIN uses u ON u.symbol = d.symbol WHERE u.path NOT IN (SELECT path FROM one) GROUP BY u.path)
SELECT path, 'License' AS via, CAST(1 AS BIGINT) AS hops FROM one UNION ALL SELECT path, via, CAST(2 AS BIGINT) FROM two""")
def symbol_ripple(spark: SparkSession, d: str) -> DataFrame:
    return kinship.ripple(corpus(spark, d).lines(), "License")


@query(f"""WITH {DOCS}, v AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'node_modules/.cache/' WHEN 1 THEN 'x/.git/worktrees/' WHEN 2 THEN 'my.cache/' ELSE '' END || path AS path FROM docs)
SELECT path, path LIKE 'node_modules/.cache/%' OR path LIKE 'x/.git/worktrees/%' AS mirror FROM v""")
def mirror_paths(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.paths import is_mirror

    heads = F.element_at(F.array(*[F.lit(x) for x in ("node_modules/.cache/", "x/.git/worktrees/", "my.cache/", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    paths = corpus(spark, d).df.select(F.concat(heads, F.col("path")).alias("path"))
    return paths.select("path", is_mirror(F.col("path")).alias("mirror"))


@query("SELECT doc_id, contains(text, '(c)') AS a, contains(text, 'e.g. [x]') AS b, contains(text, 'a+b') AS c, contains(text, '. ') AS d FROM documents")
def escaped_literals(spark: SparkSession, d: str) -> DataFrame:
    """Texts made expressions that match only themselves."""
    from ..functions import matching as M

    found = {n: Pattern(M.escape(x)).matches(F.col("text")) for n, x in (("a", "(c)"), ("b", "e.g. [x]"), ("c", "a+b"), ("d", ". "))}
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in found.items()])


@query("""SELECT o_orderkey, (SELECT i FROM (SELECT unnest(generate_series(0, 62)) AS i) WHERE (o_custkey * 2654435761) >> i & 1 = 1 ORDER BY i LIMIT 1 OFFSET 2) AS third FROM orders""")
def bit_selects(spark: SparkSession, d: str) -> DataFrame:
    """The place of the third one of a bit set."""
    from ..functions import succinct

    return table(spark, d, "orders").select("o_orderkey", succinct.select(F.col("o_custkey") * F.lit(2654435761), 2).alias("third"))


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(substr(text, 1, 60), '[a-z]+') AS m, string_split_regex(substr(text, 1, 60), '[a-z]+') AS g FROM documents WHERE regexp_matches(substr(text, 1, 60), '[a-z]')),
u AS (SELECT doc_id, unnest(m) AS match, unnest(list_slice(g, 1, len(m))) AS gap, unnest(generate_series(1, len(m))) AS i FROM s),
v AS (SELECT doc_id, match, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM u)
SELECT doc_id, CAST(e - length(match) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", match FROM v""")
def window_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches within the first sixty characters, with their spans."""
    from ..functions import matching as M

    return table(spark, d, "documents").select("doc_id", F.inline(M.finditer("[a-z]+", stop=60)(F.col("text")))).drop("groups")


@query(f"""WITH {DOCS} SELECT path, md5(text) AS digest, CAST(length(text) AS BIGINT) AS size FROM docs WHERE doc_id % 50 = 0""")
def standard_input(spark: SparkSession, d: str) -> DataFrame:
    """Documents held by the caller, laid into a corpus as rows."""
    held = [tuple(r) for r in corpus(spark, d).df.where("doc_id % 50 = 0").select("doc_id", "path", "text").toLocalIterator()]
    rows = Corpus.from_rows(spark, held).df
    return rows.select("path", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("size"))


@query("""WITH q AS (SELECT item_id, text FROM benchmark WHERE item_id % 50 = 0), g AS (SELECT DISTINCT item_id, substr(text, CAST(i AS BIGINT), 32) AS piece FROM q, LATERAL (SELECT unnest(generate_series(1, length(text) - 31)) AS i))
SELECT item_id, doc_id, count(*) AS pieces FROM g JOIN documents d ON contains(d.text, g.piece) GROUP BY ALL""")
def quoted_items(spark: SparkSession, d: str) -> DataFrame:
    """How many 32-character pieces of each query item stand in each document: queries are the items with ids divisible by 50."""
    pieces = table(spark, d, "benchmark").where("item_id % 50 = 0 and length(text) >= 32")
    pieces = pieces.select("item_id", F.explode(F.sequence(F.lit(1), F.length("text") - 31)).alias("i"), "text").select("item_id", F.expr("substring(text, i, 32)").alias("piece")).distinct()
    wanted = [r["piece"] for r in pieces.select("piece").distinct().toLocalIterator()]
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", F.explode(kinship.standing(wanted)(F.col("text"))).alias("piece")) if wanted else docs.select("doc_id", F.lit("").alias("piece")).limit(0)
    return found.join(pieces, "piece").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"))


# snapshots, codecs, folds


@query(f"""WITH {DOCS}, p AS (SELECT string_split(path, '/') AS parts, strlen(text) AS size FROM docs), a AS (SELECT unnest(generate_series(0, len(parts) - 1)) AS k, parts, size FROM p)
SELECT array_to_string(list_slice(parts, 1, k), '/') AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY 1""")
def folder_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.folders(corpus(spark, d).census()).select("folder", "files", "bytes")


@query(f"WITH {AMENDED} SELECT coalesce(d.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'delete' WHEN d.doc_id IS NULL THEN 'insert' ELSE 'update' END AS op FROM documents d FULL JOIN amended a USING (doc_id) WHERE d.text IS DISTINCT FROM a.text")
def change_journal(spark: SparkSession, d: str) -> DataFrame:
    docs, amendment = _amendment(spark, d)
    return snapshots.journal(docs, amendment.overlay(docs))


@query("""WITH b AS (SELECT DISTINCT date_trunc('hour', ts) AS s FROM events WHERE event_type = 'error')
SELECT start FROM (SELECT unnest(generate_series((SELECT min(s) FROM b), (SELECT max(s) FROM b), INTERVAL 1 HOUR)) AS start) WHERE start NOT IN (SELECT s FROM b)""")
def clean_hours(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.clean_windows(table(spark, d, "events").where("event_type = 'error'"), "ts")


@query("""WITH u AS (SELECT DISTINCT event_type, user_id FROM events), g AS (SELECT event_type, user_id - coalesce(lag(user_id) OVER (PARTITION BY event_type ORDER BY user_id), 0) AS gap FROM u)
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS bytes, true AS same FROM g GROUP BY event_type""")
def packed_postings(spark: SparkSession, d: str) -> DataFrame:
    """The users of each kind of event as a posting list of bytes, and read back."""
    from ..functions import codecs

    lists = table(spark, d, "events").groupBy("event_type").agg(F.sort_array(F.collect_set("user_id")).alias("users"))
    rows = lists.select("event_type", "users", codecs.packed("users").alias("raw"))
    return rows.select("event_type", F.size("users").cast("long").alias("n"), F.octet_length("raw").cast("long").alias("bytes"), (codecs.unpacked("raw") == F.col("users")).alias("same"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.n_nationkey AS p, b.n_nationkey AS c FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey * 2 + 1 OR b.n_nationkey = a.n_nationkey + 5),
r(node, below, n) AS (SELECT n_nationkey, n_nationkey, 1 FROM nation UNION SELECT r.node, e.c, r.n + 1 FROM r JOIN e ON r.below = e.p)
SELECT node, CAST(max(n) AS BIGINT) AS value FROM r GROUP BY node""")
def folded_depths(spark: SparkSession, d: str) -> DataFrame:
    """The nodes on the longest way down from each, as a fold over a graph without cycles."""
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    edges = keys.select(F.col("node").alias("parent"), F.explode(F.array(F.col("node") * 2 + 1, F.col("node") + 5)).alias("child"))
    return graphs.fold(keys.withColumn("value", F.lit(1).cast("long")), edges, F.max, lambda own, below: own + F.coalesce(below, F.lit(0)))


@query("""WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents)
SELECT CASE WHEN regexp_matches(c, '[a-z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(c, '[aeiou]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(c, '[0-9a-f]') THEN 4 ELSE 0 END AS classes, count(*) AS n FROM c WHERE c <> '' GROUP BY 1""")
def character_minterms(spark: SparkSession, d: str) -> DataFrame:
    """How many characters stand in each part of the coarsest partition by three classes."""
    from ..functions import syntax

    sets = [syntax.read(x).parts[0].of for x in ("[a-z]", "[aeiou]", "[0-9a-f]")]
    code = F.ascii("c")
    mark = F.lit(0)
    for bits, intervals in syntax.minterms(sets):
        inside = F.lit(False)
        for a, b in intervals:
            inside = inside | code.between(a, b)
        mark = F.when(inside, bits).otherwise(mark)
    counts = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(mark.alias("classes")).agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, 0 AS needle_id, count(*) AS n FROM ({_places('theth')}) GROUP BY doc_id UNION ALL SELECT doc_id, 1, count(*) FROM ({_places('anan')}) GROUP BY doc_id")
def backward_search(spark: SparkSession, d: str) -> DataFrame:
    return substrings.backward_counts(table(spark, d, "documents"), ["theth", "anan", "zzzzqq"])


CALLED = [f"{a}{b}th" for a in "aeio" for b in "nrst"] + ["License", "Copyright"]


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pattern_id FROM documents, (SELECT unnest({CALLED}) AS x, unnest(generate_series(1, {len(CALLED)})) AS i) WHERE contains(text, x) UNION ALL SELECT doc_id, {len(CALLED)} FROM documents WHERE regexp_matches(text, 'the [a-z]+ing') UNION ALL SELECT doc_id, {len(CALLED) + 1} FROM documents WHERE regexp_matches(text, '[0-9]{{5}}')")
def roll_call(spark: SparkSession, d: str) -> DataFrame:
    called = {x: Pattern(x, fixed=True) for x in CALLED} | {"ing": Pattern("the [a-z]+ing"), "five": Pattern("[0-9]{5}")}
    return PatternSet(called).roll_call(table(spark, d, "documents"))
