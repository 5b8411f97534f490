"""Queries of bodies, settings, published indexes, streams, cursors, units of code and character properties."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..corpus import Corpus
from ..functions.patterns import Pattern
from ..operators import indexes, kinship, lexing, units
from ..sources import files, sinks
from ..storage import materialize, scratch
from ..streaming import fresh
from .registry import DOCS, LINES, corpus, query, table
from .set_queries import AMENDED, _postings, _sketches

# bodies


@query("SELECT doc_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS size FROM documents")
def decoded_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies in UTF-8 and UTF-16 of either order, with and without a mark, made legible."""
    text, way = F.col("text"), F.col("doc_id") % 4
    mark = lambda hexed, body: F.concat(F.unhex(F.lit(hexed)), body)
    body = F.when(way == 0, mark("FFFE", F.encode(text, "UTF-16LE"))).when(way == 1, mark("FEFF", F.encode(text, "UTF-16BE"))).when(way == 2, mark("EFBBBF", F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    read = table(spark, d, "documents").select("doc_id", files.legible(body).alias("t"))
    return read.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("size"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '[^\x{00}-\x{7F}\x{A0}-\x{FF}]', '?', 'g') AS narrow FROM documents), l AS (SELECT unnest([' UTF-16', 'unicodefffe', 'Latin1 ', 'utf8']) AS label)
SELECT doc_id, label, md5(CASE WHEN label = 'Latin1 ' THEN narrow ELSE text END) AS digest FROM t, l""")
def transcoded_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies in encodings that a label names."""
    docs = table(spark, d, "documents")
    narrow = F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", "?")
    bodies = {" UTF-16": F.encode("text", "UTF-16LE"), "unicodefffe": F.encode("text", "UTF-16BE"), "Latin1 ": F.encode(narrow, "ISO-8859-1"), "utf8": F.encode("text", "UTF-8")}
    read = [docs.select("doc_id", F.lit(label).alias("label"), F.md5(files.decode(body, label).cast("binary")).alias("digest")) for label, body in bodies.items()]
    return reduce(DataFrame.unionByName, read)


def _deflated(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): the documents' bodies, each in the compression that its path's extension names."""
    @F.pandas_udf("binary")
    def deflate(text: pd.Series, kind: pd.Series) -> pd.Series:
        import bz2
        import gzip
        import lzma
        import zlib

        import zstandard

        how = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zlib": zlib.compress, "zst": lambda b: zstandard.ZstdCompressor().compress(b)}
        return pd.Series([None if t is None else how.get(k, bytes)(t.encode()) for t, k in zip(text, kind, strict=True)])

    kinds = F.element_at(F.array(*[F.lit(k) for k in ("gz", "bz2", "xz", "zlib", "zst", "txt")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return corpus(spark, d).df.select(F.concat("path", F.lit("."), kinds).alias("path"), deflate(F.col("text"), kinds).alias("content"))


@query(f"WITH {DOCS} SELECT path || '.' || ['gz', 'bz2', 'xz', 'zlib', 'zst', 'txt'][CAST(doc_id % 6 + 1 AS INT)] AS path, md5(text) AS digest FROM docs")
def inflated_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of compressed files, told by their extensions."""
    stored = _deflated(spark, d)
    return stored.select("path", F.md5(files.inflate(F.col("content"), F.col("path"))).alias("digest"))


@query(f"WITH {DOCS} SELECT path, md5(CASE WHEN path LIKE 'src1/%' THEN path || chr(10) || text ELSE text END) AS digest FROM docs WHERE text IS NOT NULL")
def preprocessed_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of some paths as a function of path and content makes them."""
    bodies = corpus(spark, d).df.where("text is not null").select("path", F.col("text").cast("binary").alias("content"))
    made = files.preprocess(bodies, lambda path, content: path.encode() + b"\n" + content, ["src1/**"])
    return made.select("path", F.md5("content").alias("digest"))


@query(f"WITH {DOCS} SELECT path FROM docs WHERE (path LIKE 'src1/%' OR path LIKE 'src2/%') AND NOT regexp_matches(path, '7[.]txt$') AND path NOT LIKE '%/de/%'")
def settings_scope(spark: SparkSession, d: str) -> DataFrame:
    """The paths that a settings file lets in."""
    found = session.Settings.parse('roots = ["src1", "src2"]\nexclude = ["*7.txt"]\nskip = ["de"]\n')
    return corpus(spark, d).df.select("path").where(found.filter().admits(F.col("path")))


SEEN = "sha256('{\"doc_id\":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',\"lang\":\"' || lang || '\"' END || '}')"


@query(f"SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr({SEEN}, 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM documents")
def table_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What is kept beside a table to know its content again."""
    return sinks.manifest(table(spark, d, "documents").select("doc_id", "lang")).select("rows", F.col("digest").cast("string").alias("digest"))


# published indexes and streams


@query("""WITH g AS (SELECT DISTINCT doc_id, substr(text, CAST(i AS BIGINT), 3) AS trigram FROM documents, LATERAL (SELECT unnest(generate_series(1, length(text) - 2)) AS i))
SELECT trigram, count(*) AS df, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(1 AS BIGINT) AS reclaimed FROM g WHERE trigram IN ('Lic', 'the', 'GNU') GROUP BY trigram""")
def published_generation(spark: SparkSession, d: str) -> DataFrame:
    """Two generations are published and the older one is reclaimed; readers follow the pointer to the newer."""
    root, docs = scratch(spark, "generations"), table(spark, d, "documents").select("doc_id", "text")
    indexes.persist_generation(spark, docs.where("text like '%License%'"), root, "1")
    indexes.persist_generation(spark, docs, root, "2")
    gone = indexes.reclaim(spark, root, keep=1)
    rows = indexes.current_generation(spark, root).where(F.col("trigram").isin("Lic", "the", "GNU"))
    return rows.groupBy("trigram").agg(F.count(F.lit(1)).alias("df"), F.sum("doc_id").alias("ids"), F.lit(len(gone)).cast("long").alias("reclaimed"))


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Change records: all documents, and later the deletion of toxic ones and new texts of those of bad quality."""
    docs, labels = corpus(spark, d).df.select("doc_id", "path", "text"), table(spark, d, "labels").select("doc_id", "toxic", "quality")
    at = lambda hour: F.to_timestamp(F.lit(f"2024-01-01 0{hour}:00:00"))
    later = docs.join(labels, "doc_id").where("toxic <> 0 or quality = 0").select("doc_id", "path", F.concat(F.lit("License "), F.col("doc_id").cast("string")).alias("text"), at(2).alias("mtime"), (F.col("toxic") != 0).alias("deleted"))
    return docs.select("*", at(1).alias("mtime"), F.lit(False).alias("deleted")), later


@query(f"WITH {AMENDED} SELECT doc_id, md5(text) AS digest, contains(text, 'Lic') AS posted FROM amended")
def followed_changes(spark: SparkSession, d: str) -> DataFrame:
    """A keeper follows a folder of change records in two batches; its documents, and whether its postings have a trigram of them."""
    root = scratch(spark, "followed")
    keeper = fresh.IndexKeeper(spark, f"{root}/index")
    for part in _changes(spark, d):
        part.write.mode("append").parquet(f"{root}/changes")
        keeper.follow(fresh.watch(spark, f"{root}/changes"), f"{root}/progress").awaitTermination()
    _, rows, docs = keeper.current()
    posted = rows.where("trigram = 'Lic'").select("doc_id", F.lit(True).alias("posted"))
    return docs.join(posted, "doc_id", "left").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.coalesce("posted", F.lit(False)).alias("posted"))


@query(f"WITH {LINES} SELECT doc_id, path, line_number, line FROM lines WHERE regexp_matches(line, '[0-9]{{4}}')")
def streamed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Matching lines of changed documents as a stream writes them."""
    root = scratch(spark, "streamed")
    _changes(spark, d)[0].write.parquet(f"{root}/changes")
    found = fresh.live_matches(fresh.watch(spark, f"{root}/changes"), Pattern("[0-9]{4}"))
    found.writeStream.format("parquet").option("path", f"{root}/lines").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/lines")


@query(f"WITH {LINES} SELECT path, line_number FROM lines WHERE regexp_matches(line, '[0-9]{{4}}') ORDER BY path, line_number LIMIT 50")
def first_results(spark: SparkSession, d: str) -> DataFrame:
    """A cursor's first rows."""
    found = corpus(spark, d).lines().where(F.rlike("line", F.lit("[0-9]{4}"))).select("path", "line_number").orderBy("path", "line_number")
    return spark.createDataFrame([tuple(r) for r in session.rows(found, 50)], found.schema)


@query("SELECT source, count(*) AS n, CAST(1 AS BIGINT) AS hits FROM documents GROUP BY source")
def kept_answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer that is asked for twice and computed once."""
    answers, asked = session.Answers(), table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        rows = answers.get("snapshot", "documents by source", lambda: asked)
    return spark.createDataFrame([(*r, answers.hits) for r in rows], "source string, n long, hits long")


COSTED = ("the ", "License", "GNU")


@query(f"""WITH w AS (SELECT unnest({list(COSTED)}) AS word), t AS (SELECT word, substr(word, CAST(i AS BIGINT), 3) AS trigram FROM w, LATERAL (SELECT unnest(generate_series(1, length(word) - 2)) AS i)),
f AS (SELECT word, trigram, (SELECT count(*) FROM documents d WHERE contains(d.text, t.trigram)) AS df FROM t), c AS (SELECT word, min(df) AS cost FROM f GROUP BY word)
SELECT word, CAST(row_number() OVER (ORDER BY cost, list_position({list(COSTED)}, word)) - 1 AS BIGINT) AS place FROM c""")
def clause_order(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of a plan, those that let the fewest documents through first."""
    clauses = {w: [[w[i : i + 3] for i in range(len(w) - 2)]] for w in COSTED}
    ordered = indexes.cheapest_first(_postings(spark, d), list(clauses.values()))
    return spark.createDataFrame([(next(w for w, c in clauses.items() if c == clause), k) for k, clause in enumerate(ordered)], "word string, place long")


# units of code: the tables hold prose, so a line's first capitalized word is made a declaration

DECLARING = "(?:^|\\s)(?:def|fn|func|function|class|struct|enum|trait|interface|impl)\\s+[A-Za-z_][A-Za-z0-9_]*"
CODE = LINES.replace("AS path, text FROM documents)", "AS path, regexp_replace(text, '(?m)^([A-Z][a-z]+) ', 'class \\1 ', 'g') AS text FROM documents)")
UNITS = (
    CODE
    + f""", flagged AS (SELECT *, regexp_matches(line, '{DECLARING}') AND NOT regexp_matches(line, '^\\s*(//|#|/\\*|\\*|\\\\\\\\)') AS declares FROM lines),
numbered AS (SELECT *, sum(CASE WHEN declares THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_number) AS unit FROM flagged),
lasting AS (SELECT *, max(CASE WHEN trim(line) <> '' THEN line_number END) OVER (PARTITION BY doc_id, unit) AS last FROM numbered WHERE unit > 0),
units AS (SELECT doc_id, path, min(line_number) AS line_start, max(line_number) AS line_end, trim(min_by(line, line_number)) AS headline, string_agg(line, chr(10) ORDER BY line_number) AS text
  FROM lasting WHERE line_number <= last GROUP BY doc_id, path, unit)"""
)


def _code(spark: SparkSession, d: str) -> Corpus:
    return Corpus(corpus(spark, d).df.select("doc_id", "path", F.regexp_replace("text", r"(?m)^([A-Z][a-z]+) ", "class $1 ").alias("text")))


@query(f"WITH {UNITS} SELECT path, line_start, line_end, headline FROM units")
def code_units(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of text that begin at declaring lines."""
    return units.functions(_code(spark, d), 1).select("path", "line_start", "line_end", "headline")


@query(f"WITH {UNITS} SELECT path, line_start, line_end, headline, CAST(len(regexp_extract_all(text, '\\bthe\\b')) AS BIGINT) AS uses FROM units WHERE line_end > line_start AND regexp_matches(text, '\\bthe\\b') ORDER BY uses DESC, path, line_start LIMIT 10")
def code_context(spark: SparkSession, d: str) -> DataFrame:
    """The units that use a word most."""
    return units.context(_code(spark, d), "the")


NAMED = "(?:^|\\s)(?:def|fn|func|function|class|struct|enum|trait|interface|type|const)\\s+([A-Za-z_][A-Za-z0-9_]*)"


@query(f"""WITH {UNITS}, w AS (SELECT path, line_number, list_distinct(regexp_extract_all(line, '{NAMED}', 1)) AS defined, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))) AS symbol FROM lines),
k AS (SELECT path, line_number, symbol, list_contains(defined, symbol) AS defines FROM w), own AS (SELECT * FROM k WHERE symbol = 'License'),
uses AS (SELECT DISTINCT symbol, path FROM k WHERE NOT defines), defs AS (SELECT DISTINCT symbol, path FROM k WHERE defines), one AS (SELECT path FROM uses WHERE symbol = 'License'),
two AS (SELECT u.path, min(u.symbol) AS via FROM one JOIN defs d ON one.path = d.path JOIN uses u ON u.symbol = d.symbol WHERE u.path NOT IN (SELECT path FROM one) GROUP BY u.path)
SELECT 'definition' AS role, path, line_number AS line, '' AS detail FROM own WHERE defines UNION ALL SELECT 'dependent', path, line_number, '' FROM own WHERE NOT defines
UNION ALL SELECT DISTINCT 'dependency', u.path, u.line_start, detail FROM (SELECT path, line_start, line_end, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]{{2,}})\\s*\\(', 1)) AS detail FROM units) u
  JOIN own o ON o.path = u.path AND o.defines AND o.line_number BETWEEN u.line_start AND u.line_end WHERE detail <> 'License'
UNION ALL SELECT 'ripple', path, 2, via FROM two
UNION ALL SELECT 'comment', path, line_number, trim(line) FROM lines WHERE contains(line, 'License') AND regexp_matches(line, '^\\s*(//|#|/\\*|\\*|\\\\\\\\)')""")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """What a change of one symbol touches."""
    return units.blast(_code(spark, d), "License")


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?(?:-->|\z)|"(?:\\.|[^"\\\n])*"?') AS m, string_split_regex(html, '(?s)<!--.*?(?:-->|\z)|"(?:\\.|[^"\\\n])*"?') AS g FROM pages),
u AS (SELECT page_id, unnest(m) AS mark, unnest(list_slice(g, 1, len(m))) AS gap, unnest(generate_series(1, len(m))) AS i FROM t WHERE len(m) > 0),
v AS (SELECT page_id, mark, sum(length(gap) + length(mark)) OVER (PARTITION BY page_id ORDER BY i) - length(mark) AS base, i FROM u),
c AS (SELECT page_id, i, base, regexp_extract_all(mark, '[a-z]+') AS m, string_split_regex(mark, '[a-z]+') AS g FROM v WHERE starts_with(mark, '<!--')),
x AS (SELECT page_id, i, base, unnest(m) AS match, unnest(list_slice(g, 1, len(m))) AS gap, unnest(generate_series(1, len(m))) AS j FROM c WHERE len(m) > 0),
y AS (SELECT page_id, match, base + sum(length(gap) + length(match)) OVER (PARTITION BY page_id, i ORDER BY j) AS e FROM x)
SELECT page_id, CAST(e - length(match) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", match FROM y""")
def comment_scope(spark: SparkSession, d: str) -> DataFrame:
    """Words inside the comments of pages."""
    return lexing.scoped_matches(table(spark, d, "pages"), "[a-z]+", (lexing.COMMENT,), lexing.FAMILIES["markup"], text="html", keep=("page_id",))


# characters and names

PROPERTIES = ("Greek", "Cyrillic", "Lu", "Nd")


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '\\p{{{p}}}')) AS BIGINT) AS {p.lower()}" for p in PROPERTIES) + " FROM documents")
def property_counts(spark: SparkSession, d: str) -> DataFrame:
    """Characters of a script or category, told by the ranges of its code points."""
    from ..functions import matching as M

    counted = table(spark, d, "documents").select("doc_id", M.property_counts(list(PROPERTIES))(F.col("text")).alias("n"))
    return counted.select("doc_id", *[F.col("n")[k].alias(p.lower()) for k, p in enumerate(PROPERTIES)])


@query("SELECT * FROM (VALUES ('K', 'K,k,K'), ('s', 'S,s,ſ'), ('x', 'X,x'), ('1', '1'), ('µ', 'µ,Μ,μ'), ('σ', 'Σ,ς,σ')) t(letter, orbit)")
def fold_orbits(spark: SparkSession, d: str) -> DataFrame:
    """Characters that are equal but for case: the values of Unicode's simple folding."""
    from ..functions import matching as M

    return spark.createDataFrame([(c, ",".join(M.fold_orbit(c))) for c in "Ksx1µσ"], "letter string, orbit string")


@query("""WITH w AS (SELECT DISTINCT event_type AS known FROM events), n AS (SELECT event_id, substr(event_type, 2) || CASE WHEN event_id % 3 = 0 THEN 'zzz' ELSE '' END AS name FROM events),
s AS (SELECT event_id, name, known, damerau_levenshtein(name, known) AS d FROM n, w), b AS (SELECT event_id, name, min(d) AS d FROM s GROUP BY ALL)
SELECT b.event_id, b.name, CASE WHEN b.d <= greatest(1, length(b.name) // 4) AND count(*) = 1 THEN min(s.known) END AS nearest FROM b JOIN s USING (event_id, d) GROUP BY b.event_id, b.name, b.d""")
def nearest_known(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt names and the known one that is meant."""
    events = table(spark, d, "events")
    known = sorted(r[0] for r in events.select("event_type").distinct().toLocalIterator() if r[0] is not None)
    cut = F.when(F.col("event_id") % 3 == 0, "zzz").otherwise("")
    return events.select("event_id", F.concat(F.expr("substring(event_type, 2)"), cut).alias("name")).withColumn("nearest", lexing.nearest_names(F.col("name"), known))


# a word begins behind what is no letter, mark, digit or connector
BEGINS = r"(^|[^\pL\pM\p{Nd}\p{Pc}])([a-z])"
RAISED = f"regexp_replace(text, '{BEGINS}', '\\1' || upper(regexp_extract(text, '{BEGINS}', 2)))"


@query(f"""WITH a AS (SELECT item_id, text, len(regexp_extract_all(text, '{BEGINS}')) AS n FROM benchmark), b AS (SELECT item_id, n, {RAISED} AS text FROM a), c AS (SELECT item_id, n, {RAISED} AS text FROM b)
SELECT item_id, {RAISED} AS text, CAST(least(n, 3) AS BIGINT) AS n FROM c""")
def replaced_by_callback(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import matching as M

    made = M.sub_with(r"\b[a-z]", lambda m: m[0].upper(), most=3)(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", made.alias("r")).select("item_id", "r.text", "r.n")


# families


@query(None)
def nearest_misses(spark: SparkSession, d: str) -> DataFrame:
    """Documents in no family and what comes nearest to them."""
    return kinship.nearest_misses(_sketches(spark, d))


@query(None)
def code_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Units of one shape."""
    found = units.concepts(_code(spark, d))
    return found.select("label", F.array_join("members", ",").alias("members"), "repeated_lines", "structure_distance")


@query(None)
def packed_sources(spark: SparkSession, d: str) -> DataFrame:
    """The documents that together hold the most of each query item: items whose ids are divisible by 50."""
    docs = materialize(corpus(spark, d).df.select("path", "text"), "packed")
    items = table(spark, d, "benchmark").where("item_id % 50 = 0 and text is not null").select("item_id", "text").orderBy("item_id")
    parts = [kinship.pack(docs, r["text"], chunk=8).select(F.lit(r["item_id"]).alias("item_id"), "*") for r in items.toLocalIterator()]
    return reduce(DataFrame.unionByName, parts)
