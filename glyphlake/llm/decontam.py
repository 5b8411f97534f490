"""Benchmark decontamination with a positional inverted index split by documents.

The index is dealt by documents, as large search engines do: every block of documents has its own
term dictionary and, for each term, the ascending list of positions at which it stands.  It is stored, and
searches read it from there.  A phrase is
looked up in every block by itself: its rarest term in that block gives the starting points, and the
lists of its other terms, moved by their offsets, are intersected from the rarest on.  So no posting
ever moves between tasks, no list of a frequent term meets another one whole, and the phrases, a set
that is stated and small against the corpus, are sent to the blocks in pieces of bounded size.

Words are lower-cased (A-Z) runs of digits, letters and characters outside ASCII, taken from whole
texts.  A phrase is `window` consecutive words of a benchmark item, or the whole item if it is
shorter.  Results are exact.

Defined results: null and empty texts have no words and are never hit; items without words give no
phrase; repeated documents or items are separate rows.  Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, materialize, release

#: ASCII bytes other than digits and letters become spaces, A-Z become a-z.
WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER_AZ)
WINDOW = 10
#: Other words that may stand between a phrase's words in a proximity match.
SLOP = 5
#: Text bytes in a block of the index; a single longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of benchmark text that are sent to the tasks at once; more items are matched in several passes.
QUERY_BYTES = 4 << 20
INDEX_SCHEMA = "doc_ids array<{id}>, starts binary, terms binary, offsets binary, positions binary"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


class Block:
    """The inverted index of some documents: position lists by term, over all their words in a row."""

    def __init__(self, starts: np.ndarray, terms: list[bytes], offsets: np.ndarray, positions: np.ndarray):
        self.starts, self.terms, self.offsets, self.positions = starts, terms, offsets, positions

    @classmethod
    def build(cls, texts: list[bytes | None]) -> Block:
        numbers: dict[bytes, int] = {}
        ids, starts = [], [0]
        for text in texts:
            found = [numbers.setdefault(w, len(numbers)) for w in words(text)]
            ids.append(np.asarray(found, np.int32))
            starts.append(starts[-1] + len(found))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        positions = np.argsort(flat, kind="stable").astype(np.int32 if len(flat) < 2**31 else np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(numbers)))]).astype(np.int64)
        return cls(np.asarray(starts, np.int64), list(numbers), offsets, positions)

    def lookup(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of a phrase in a document: its number and its first position."""
        numbers = self.numbers
        known = np.asarray([numbers.get(t, -1) for t in phrases.terms] + [-2], np.int64)  # -2: behind a short phrase's end
        terms = known[phrases.words]
        live = np.flatnonzero((terms != -1).all(axis=1))
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms = terms[live]
        counts = np.where(terms >= 0, np.diff(self.offsets)[np.maximum(terms, 0)], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")  # each phrase's words from the rarest on
        size = int(self.starts[-1])
        keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.offsets)) * size + self.positions
        rare = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
        n = self.offsets[rare + 1] - self.offsets[rare]
        phrase = np.repeat(np.arange(len(live)), n)
        begin = self.positions[np.repeat(self.offsets[rare] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] - order[phrase, 0]
        for rank in range(1, terms.shape[1]):
            at = order[phrase, rank]
            term = terms[phrase, at]
            place = begin + at
            wanted = term * size + place
            found = np.searchsorted(keys, wanted)
            found[found == len(keys)] = 0
            ok = (term < 0) | ((keys[found] == wanted) & (place >= 0) & (place < size))
            phrase, begin = phrase[ok], begin[ok]
            if not len(phrase):
                break
        length = phrases.lengths[live][phrase]
        ok = begin >= 0
        phrase, begin, length = phrase[ok], begin[ok], length[ok]
        doc = np.searchsorted(self.starts, begin, side="right")
        inside = begin + length <= self.starts[np.minimum(doc, len(self.starts) - 1)]
        return live[phrase[inside]], begin[inside]

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.terms)}

    def near(self, phrase: list[bytes], slop: int) -> list[tuple[int, int, int]]:
        """Proximity: (document, first, last position) of the shortest spans that hold the phrase's words in
        order with at most `slop` other words between them, one for each place of the first word."""
        numbers = self.numbers
        if not phrase or any(t not in numbers for t in phrase):
            return []
        lists = [self.positions[self.offsets[k] : self.offsets[k + 1]] for k in map(numbers.__getitem__, phrase)]
        first = at = lists[0].astype(np.int64)
        for places in lists[1:]:
            following = np.searchsorted(places, at, side="right")
            ok = following < len(places)
            first, at = first[ok], places[following[ok]].astype(np.int64)
        doc = np.searchsorted(self.starts, first, side="right") - 1
        ok = (at < self.starts[doc + 1]) & (at - first + 1 - len(phrase) <= slop)
        return list(zip(doc[ok].tolist(), first[ok].tolist(), at[ok].tolist(), strict=True))


class Phrases:
    """Distinct phrases as rows of term numbers, and the items that each comes from."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        rows, owners = [], []
        for k, (_, text) in enumerate(items):
            found = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words(text)), np.int32)
            if 0 < len(found) < window:
                found = np.concatenate([found, np.full(window - len(found), -1, np.int32)])
            if len(found):
                rows.append(np.lib.stride_tricks.sliding_window_view(found, window))
                owners.append(np.full(len(rows[-1]), k, np.int32))
        self.terms, self.names = list(numbers), [name for name, _ in items]
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.words, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.words >= 0).sum(axis=1)
        self.words = np.where(self.words < 0, np.int32(len(numbers)), self.words)
        # the items of phrase p are owners[starts[p] : starts[p + 1]]
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)]), axis=1) if rows else np.zeros((2, 0), np.int64)
        self.starts, self.owners = np.searchsorted(pairs[0], np.arange(len(self.words) + 1)), pairs[1]

    def items(self, phrase: int) -> set[str]:
        return {self.names[k] for k in self.owners[self.starts[phrase] : self.starts[phrase + 1]].tolist()} - {None}


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block: the documents, where each begins, the terms (joined by spaces) and their position lists."""
    schema = INDEX_SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def row(ids: list, texts: list) -> pa.RecordBatch:
            block = Block.build(texts)
            packed = [block.starts.astype("<i8").tobytes(), b" ".join(block.terms), block.offsets.astype("<i8").tobytes(), block.positions.astype("<i8" if block.positions.dtype == np.int64 else "<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), *[pa.array([x], pa.large_binary()).cast(pa.binary()) for x in packed]], names=["doc_ids", "starts", "terms", "offsets", "positions"])

        ids, texts, size = [], [], 0
        for batch in batches:
            kind = batch.column(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                ids.append(key)
                texts.append(text)
                size += len(text or b"")
                if size >= BLOCK_BYTES:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def stored_index(docs: DataFrame, **columns: str) -> DataFrame:
    """The index, written to the shared folder: searches read the postings, not the texts."""
    return materialize(build_index(docs, **columns), "postings")


def _unpack(batch: pa.RecordBatch, k: int) -> tuple[list, Block]:
    raw = {n: batch.column(n)[k].as_py() for n in ("starts", "terms", "offsets", "positions")}
    offsets = np.frombuffer(raw["offsets"], "<i8")
    wide = len(raw["positions"]) == 8 * int(offsets[-1]) and offsets[-1] > 0
    block = Block(np.frombuffer(raw["starts"], "<i8"), raw["terms"].split(b" ") if raw["terms"] else [], offsets, np.frombuffer(raw["positions"], "<i8" if wide else "<i4"))
    return batch.column("doc_ids")[k].as_py(), block


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark in pieces of at most QUERY_BYTES, read one row at a time."""
    piece, size = [], 0
    for key, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        text = bytes(text) if text is not None else None
        if piece and size + len(text or b"") > QUERY_BYTES:
            yield piece
            piece, size = [], 0
        piece.append((key, text))
        size += len(text or b"")
    yield piece


SPANS = "array<struct<first:long,last:long>>"
FOUND = pa.list_(pa.struct([("doc", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))


def search(index: DataFrame, items: DataFrame, *, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Exact phrase matches: one row a document with n_words, the hit spans [first, last] and the items found.

    A benchmark of several pieces passes over each block in turn, which gathers what was found in it."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    pieces = _passes(items, item_id, item_text)
    piece = next(pieces)
    blocks = index.withColumns({"found": F.array().cast("array<struct<doc:long,first:long,last:long>>"), "named": F.array().cast("array<array<string>>")})
    written = None
    while piece is not None:
        sent = index.sparkSession.sparkContext.broadcast(Phrases(piece, window))
        piece = next(pieces, None)
        final = piece is None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, final=final) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, block = _unpack(batch, k)
                    spans, names = _occurrences(block, phrases, len(ids))
                    spans = [s + [(x["first"], x["last"]) for x in batch.column("found")[k].as_py() if x["doc"] == d] for d, s in enumerate(spans)] if len(batch.column("found")[k]) else spans
                    names = [a | set(b) for a, b in zip(names, batch.column("named")[k].as_py(), strict=True)] if len(batch.column("named")[k]) else names
                    if final:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids, batch.column("doc_ids").type.value_type),
                                pa.array(np.diff(block.starts), pa.int64()),
                                pa.array([[{"first": a, "last": b} for a, b in _joined(s)] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                                pa.array([sorted(n) for n in names], pa.list_(pa.string())),
                            ],
                            names=["id", "n_words", "spans", "items"],
                        )
                    else:
                        found = [{"doc": d, "first": a, "last": b} for d, s in enumerate(spans) for a, b in _joined(s)]
                        own = batch.slice(k, 1)
                        yield pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array([found], FOUND), pa.array([[sorted(n) for n in names]], pa.list_(pa.list_(pa.string())))], names=own.schema.names)

        blocks = blocks.mapInArrow(run, f"id {kind}, n_words long, spans {SPANS}, items array<string>" if final else blocks.schema)
        if not final:
            blocks = materialize(blocks, "matches")
            sent.unpersist()
            if written is not None:
                release(written)
            written = blocks
    return blocks.withColumnRenamed("id", id_col)


def _occurrences(block: Block, phrases: Phrases, n_docs: int) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """For each document of a block its spans [first, last] and the items whose phrases stand in it."""
    which, begin = block.lookup(phrases)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    names: list[set[str]] = [set() for _ in range(n_docs)]
    doc = np.searchsorted(block.starts, begin, side="right") - 1
    first = begin - block.starts[doc]
    for d, w, a in zip(doc.tolist(), which.tolist(), first.tolist(), strict=True):
        spans[d].append((a, a + int(phrases.lengths[w]) - 1))
        names[d] |= phrases.items(w)
    return spans, names


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and adjacent ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_near(index: DataFrame, items: DataFrame, *, slop: int = SLOP, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Proximity matches of each item's first `window` words: (document, item_id, first, last) as word positions, where
    they stand in order with at most `slop` other words between; one row for each place of the first word."""
    kind, item_kind = index.schema["doc_ids"].dataType.elementType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = None
    for piece in _passes(items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")), "i", "t"):
        sent = index.sparkSession.sparkContext.broadcast([(name, words(text)[:window]) for name, text in piece])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, block = _unpack(batch, k)
                    found = [(ids[d], name, int(a - block.starts[d]), int(z - block.starts[d])) for name, phrase in sent.value for d, a, z in block.near(phrase, slop)]
                    kinds = [batch.column("doc_ids").type.value_type, pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["id", "item", "first", "last"])

        part = index.mapInArrow(run, f"id {kind}, item string, first long, last long")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("item").cast(item_kind).alias(item_id), "first", "last")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document; the postings are stored first."""
    found = search(stored_index(docs), items, window=window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any phrase of the items, with all their columns.

    Rows pass through blocks of the index that are searched at once and not kept, so no row moves.  Documents with null
    or empty texts stay; repeated rows are judged alike; a long text is a block of its own; without items all stay."""
    out = docs
    for piece in _passes(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(piece, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("text"))
                keep, texts, size = [], [], 0
                for k, text in enumerate(column):
                    texts.append(text.as_py().encode() if text.is_valid else None)
                    size += len(texts[-1] or b"")
                    if size >= BLOCK_BYTES or k == len(column) - 1:
                        keep += [not s for s in _occurrences(Block.build(texts), phrases, len(texts))[0]]
                        texts, size = [], 0
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of contamination(): every run of words of a document is compared with every window."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, i, i + {window - 1}) AS p FROM b, LATERAL (SELECT unnest(generate_series(1, CAST(greatest(1, len(w) - {window - 1}) AS BIGINT))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(p) AS n FROM win),
runs AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS p FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, CAST(len(w) - n + 1 AS BIGINT))) AS i)),
found AS (SELECT r.rid, r.i, r.n, win.item FROM runs r JOIN win ON r.p = win.p),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM found) f, LATERAL (SELECT unnest(generate_series(f.i, f.i + f.n - 1)) AS k) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""
