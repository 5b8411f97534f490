"""Candidate indexes: they narrow what is read, and never answer.

A trigram index is a table of (trigram, doc_id) rows, stored as lists of documents and clustered by trigram, so a
query's scan reads the few row groups of its trigrams.  Class runs are columns beside the documents.  Every answer
is verified on the documents that a candidate set leaves.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import syntax
from ..functions.patterns import Pattern, needs_backtracking
from ..storage import bound_batches, kept

#: The classes whose longest runs are kept, in the ASCII reading.
RUN_CLASSES = {
    "digit": "[0-9]", "hex": "[0-9A-Fa-f]", "upper": "[A-Z]", "lower": "[a-z]", "alpha": "[A-Za-z]", "word": "[A-Za-z0-9_]", "space": "[ \\t-\\r]",
    "punct": "[!-/:-@\\[-^`{-~]", "literal_space": "[ ]", "dot": "[.]", "quote": "[\"']", "lparen": "[(]", "slash": "[/\\\\]", "under": "[_]", "assign_sep": "[=:]",
}
RUN_RANKS, RUN_MOST = 4, 65535


# trigrams


def distinct_trigrams(text: Column) -> Column:
    """In one pass: a look-ahead at every place, except inside a surrogate pair."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1)))


def posting_lists(docs: DataFrame) -> DataFrame:
    """(trigram, docs): each trigram of a batch of documents with those that have it; a trigram has a row a batch."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts, which = trigrams_of(batch.column(1).to_pylist())
            if len(grams):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), batch.column(0).take(pa.array(which)))
                yield pa.RecordBatch.from_arrays([pa.array(grams), lists], names=["trigram", "docs"])

    return rows.mapInArrow(run, StructType([StructField("trigram", StringType()), StructField("docs", ArrayType(rows.schema["doc_id"].dataType))]))


def trigrams_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of texts, in how many texts each is, and these texts' places one trigram behind the other.

    A trigram and its text are one number, so one sort finds and groups them."""
    n = np.array([len(t or "") for t in texts])
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return [], n[:0], n[:0]
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(len(seen), np.int64)
    number[letters] = np.arange(len(letters))
    c, k, text = number[codes], len(letters), np.repeat(np.arange(len(texts)), n)
    inside = text[:-2] == text[2:]
    grams, text = ((c[:-2] * k + c[1:-1]) * k + c[2:])[inside], text[:-2][inside]
    names = None
    if k**3 * len(texts) >= 1 << 62:  # of many letters and texts: number the trigrams that there are
        names, grams = np.unique(grams, return_inverse=True)
    both = grams * len(texts) + text
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    grams, which = both // len(texts), both % len(texts)
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else grams
    first = grams[starts] if names is None else names[grams[starts]]
    spelled = np.stack([letters[first // k // k], letters[first // k % k], letters[first % k]], axis=1).astype(np.uint32)
    whole = spelled.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + 3] for i in range(0, len(whole), 3)], np.diff(np.append(starts, len(grams))), which


def unlisted(lists: DataFrame) -> DataFrame:
    """(trigram, doc_id) of posting lists."""
    return lists.select("trigram", F.explode("docs").alias("doc_id"))


def postings(docs: DataFrame) -> DataFrame:
    """(trigram, doc_id), each pair once."""
    return unlisted(posting_lists(docs))


def write_lists(lists: DataFrame, path: str, mode: str = "errorifexists", partitions: int | None = None) -> None:
    """Posting lists sorted by trigram, so that row-group statistics select a trigram's rows."""
    order = [F.col("trigram"), F.element_at("docs", 1)]
    ranged = lists.repartitionByRange(partitions, *order) if partitions else lists.repartitionByRange(*order)
    ranged.sortWithinPartitions("trigram").write.mode(mode).parquet(path)


def build(docs: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the posting lists of documents; unlisted() reads them."""
    write_lists(posting_lists(docs), path, partitions=partitions)


def frequencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))


def literal_trigrams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def candidates_literal(rows: DataFrame, literal: str) -> DataFrame | None:
    """Documents with every trigram of a literal; None if it is too short to narrow anything."""
    grams = literal_trigrams(literal)
    if not grams:
        return None
    hit = rows.where(F.col("trigram").isin(grams)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return hit.where(F.col("n") == len(grams)).select("doc_id")


def candidates_short(rows: DataFrame, docs: DataFrame, needle: str) -> DataFrame:
    """Candidates of a needle of one or two characters: its extensions, and documents too short for trigrams."""
    like = F.contains(F.col("trigram"), F.lit(needle)) if len(needle) == 1 else F.startswith(F.col("trigram"), F.lit(needle)) | F.endswith(F.col("trigram"), F.lit(needle))
    return rows.where(like).select("doc_id").union(docs.where(F.length("text") < 3).select("doc_id")).distinct()


def candidates_cnf(rows: DataFrame, clauses: list[list[list[str]]]) -> DataFrame:
    """Documents for and(or(and(trigram))): one aggregation over the trigrams of all clauses."""
    wanted = sorted({t for clause in clauses for term in clause for t in term})
    has = {t: F.max(F.when(F.col("trigram") == t, True).otherwise(False)) for t in wanted}
    found = rows.where(F.col("trigram").isin(wanted)).groupBy("doc_id").agg(*[has[t].alias(f"t{i}") for i, t in enumerate(wanted)])
    number = {t: F.col(f"t{i}") for i, t in enumerate(wanted)}
    whole = F.lit(True)
    for clause in clauses:
        some = F.lit(False)
        for term in clause:
            every = F.lit(True)
            for t in term:
                every = every & number[t]
            some = some | every
        whole = whole & some
    return found.where(whole).select("doc_id")


def verify(docs: DataFrame, candidates: DataFrame | None, pattern: Pattern) -> DataFrame:
    """The documents of a candidate set that really match."""
    kept = docs if candidates is None else docs.join(candidates, "doc_id", "left_semi")
    return kept.where(pattern.matches(F.col("text")))


@dataclass(frozen=True)
class Amendment:
    """Changed and deleted documents on top of a built index."""

    upserts: DataFrame  # documents
    deleted: DataFrame  # doc_id

    def apply(self, rows: DataFrame) -> DataFrame:
        gone = self.deleted.select("doc_id").union(self.upserts.select("doc_id")).distinct()
        return rows.join(gone, "doc_id", "left_anti").select("trigram", "doc_id").unionByName(postings(self.upserts))

    def overlay(self, docs: DataFrame) -> DataFrame:
        gone = self.deleted.select("doc_id").union(self.upserts.select("doc_id")).distinct()
        return docs.join(gone, "doc_id", "left_anti").unionByName(self.upserts.select(*docs.columns))


def changed(files: DataFrame, anchor) -> DataFrame:
    """Files whose clocks are at or behind the build's anchor, or unknown: equality counts as changed."""
    clocks = [c for c in ("mtime", "ctime") if c in files.columns]
    out = F.col("mtime").isNull()
    for c in clocks:
        out = out | (F.col(c) >= F.lit(anchor))
    return files.where(out)


def fresh_candidates(candidates: DataFrame, changed_files: DataFrame) -> DataFrame:
    """What an index names, and all that changed since it was built."""
    return candidates.select("doc_id").union(changed_files.select("doc_id")).distinct()


def reading_list(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their sizes, the cheapest to read first."""
    return docs.join(candidates, "doc_id", "left_semi").select("doc_id", "path", F.octet_length("text").cast("long").alias("size")).orderBy("size", "doc_id")


# class runs


def run_lengths(text: Column, name: str) -> Column:
    """Lengths of all runs of a class, longest first, at most RUN_RANKS."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({RUN_CLASSES[name]}+)"), F.lit(1)), lambda r: F.least(F.length(r), F.lit(RUN_MOST)))
    return F.slice(F.sort_array(runs, asc=False), 1, RUN_RANKS)


def longest_run(text: Column, name: str) -> Column:
    return F.coalesce(F.array_max(run_lengths(text, name)), F.lit(0)).cast("long")


def with_runs(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    return docs.withColumns({f"run_{n}": longest_run(F.col("text"), n) for n in (RUN_CLASSES if names is None else names)})


@dataclass(frozen=True)
class _Run:
    """What is certain of every match's runs of a class: whether all of it is one, its least length, and the least
    runs at its start, at its end and anywhere."""

    whole: bool
    least: int
    start: int
    end: int
    best: int

    def then(self, other: _Run) -> _Run:
        start = self.least + other.start if self.whole else self.start
        end = other.least + self.end if other.whole else other.end
        return _Run(self.whole and other.whole, self.least + other.least, start, end, max(self.best, other.best, self.end + other.start))


_EMPTY = _Run(True, 0, 0, 0, 0)


def _runs(node, members: syntax.Intervals) -> _Run:
    if isinstance(node, syntax.Char):
        inside = node.of is not None and syntax.common(node.of, members) == node.of
        return _Run(True, 1, 1, 1, 1) if inside else _Run(False, 1, 0, 0, 0)
    if isinstance(node, syntax.Anchor):
        return _EMPTY
    if isinstance(node, syntax.Sequence):
        out = _EMPTY
        for part in node.parts:
            out = out.then(_runs(part, members))
        return out
    if isinstance(node, syntax.Choice):
        parts = [_runs(p, members) for p in node.parts]
        return _Run(all(p.whole for p in parts), *(min(getattr(p, k) for p in parts) for k in ("least", "start", "end", "best")))
    part = _runs(node.part, members)
    if part.whole:
        length = part.least * node.low
        return _Run(True, length, length, length, length)
    if not node.low:
        return _Run(False, 0, 0, 0, 0)
    return _Run(False, part.least * node.low, part.start, part.end, max(part.best, part.end + part.start if node.low > 1 else 0))


def required_runs(pattern: str, unicode: bool = True) -> list[list[tuple[str, int]]]:
    """For each alternative the class runs that any match must contain; an empty list prunes nothing.

    Read from the pattern's tree; of a pattern that isn't read with certainty nothing is required."""
    try:
        if needs_backtracking(pattern):
            return []
        tree = syntax.read(pattern, unicode)
    except (syntax.Unclear, RecursionError):
        return []
    while isinstance(tree, syntax.Sequence) and len(tree.parts) == 1:
        tree = tree.parts[0]
    branches = tree.parts if isinstance(tree, syntax.Choice) else (tree,)
    members = {n: _members(c) for n, c in RUN_CLASSES.items()}
    out = []
    for b in branches:
        least = {n: best for n, c in members.items() if (best := _runs(b, c).best)}
        # a run of a class is one of every class that holds it
        implied = {n for n in least for m in least if m != n and least[m] >= least[n] and syntax.common(members[m], members[n]) == members[m]}
        out.append([(n, best) for n, best in least.items() if n not in implied])
    return out if all(out) else []


def run_names(requirements: list[list[tuple[str, int]]]) -> list[str]:
    """The classes that a prune reads."""
    return sorted({n for alternative in requirements for n, _ in alternative})


def _members(bracket: str) -> syntax.Intervals:
    compiled = re.compile(bracket)
    return syntax.normal([(c, c) for c in range(128) if compiled.fullmatch(chr(c))])


def survives(requirements: list[list[tuple[str, int]]]) -> Column:
    """Whether some alternative's runs are all there; without requirements everything survives."""
    if not requirements:
        return F.lit(True)
    out = F.lit(False)
    for alternative in requirements:
        every = F.lit(True)
        for name, least in alternative:
            every = every & (F.col(f"run_{name}") >= min(least, RUN_MOST))
        out = out | every
    return out


def stored_postings(docs: DataFrame, key: str) -> DataFrame:
    """The postings of a corpus, built once an application and sorted by trigram: a query reads the row groups of its trigrams."""
    return unlisted(kept(docs.sparkSession, f"postings:{key}", lambda path: build(docs, path)))


def stored_runs(docs: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """(doc_id, run_...): class runs of a corpus, all or those named, built once an application."""
    chosen = names if names is not None else list(RUN_CLASSES)
    return kept(docs.sparkSession, f"runs:{key}:{','.join(chosen)}", lambda path: with_runs(docs, chosen).select("doc_id", *[f"run_{n}" for n in chosen]).write.parquet(path))


def persist_generation(spark: SparkSession, docs: DataFrame, root: str, generation: str) -> str:
    """Build an index generation and publish it: readers follow the pointer table, which is replaced last."""
    target = f"{root}/generation-{generation}"
    build(docs, target)
    publish(spark, root, target)
    return target


def publish(spark: SparkSession, root: str, target: str) -> None:
    """Move the pointer: a file of a higher number is made beside the old ones and renamed into sight, so that readers
    see the old target or the new one, never none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(conf)
    number = max((n for n, _ in _pointers(spark, root)), default=-1) + 1
    hidden = jvm.org.apache.hadoop.fs.Path(f"{root}/_next-{uuid.uuid4().hex}")
    out = system.create(hidden, False)
    out.write(bytearray(target.encode()))
    out.close()
    if not system.rename(hidden, jvm.org.apache.hadoop.fs.Path(f"{root}/current-{number:012d}")):
        raise RuntimeError(f"another writer has published generation {number} of {root}")
    for old, path in _pointers(spark, root):
        if old < number - 1:
            system.delete(path, False)


def _pointers(spark: SparkSession, root: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath() for s in system.listStatus(path)]
    return sorted(((int(p.getName()[8:]), p) for p in names if p.getName().startswith("current-")), key=lambda x: x[0])


def published(spark: SparkSession, root: str) -> str | None:
    """What the newest pointer names."""
    found = _pointers(spark, root)
    return spark.read.text(found[-1][1].toString(), wholetext=True).first()["value"] if found else None


def current_generation(spark: SparkSession, root: str) -> DataFrame:
    return unlisted(spark.read.parquet(published(spark, root)))


def reclaim(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest generations and the published one; returns what was deleted."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(top) if s.getPath().getName().startswith("generation-"))
    live = published(spark, root).rstrip("/").rpartition("/")[2]
    gone = [n for _, n in found[: max(0, len(found) - keep)] if n != live]
    for name in gone:
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return gone


def cheapest_first(rows: DataFrame, clauses: list[list[list[str]]]) -> list[list[list[str]]]:
    """The clauses of a plan by how many documents they let through at most, from trigram frequencies."""
    wanted = sorted({t for clause in clauses for term in clause for t in term})
    df = {r["trigram"]: r["df"] for r in frequencies(rows.where(F.col("trigram").isin(wanted))).collect()} if wanted else {}
    cost = lambda clause: sum(min((df.get(t, 0) for t in term), default=0) for term in clause)
    return sorted(clauses, key=cost)
