"""Quality by supervised subword embeddings.

A document is the average of learned vectors of its words and their character n-grams, hashed into a
fixed number of buckets, and a softmax over that average gives the classes.  Two more learned vectors
stand for a word that repeats the one before it and for a text without words.  Training is numpy
stochastic gradient descent over a bounded sample of labelled documents; all texts are then scored
whole.  As average and output layer are linear, a word's part in the logit is computed once and kept.

Defined results: null and empty texts score as the empty-text feature; copies score alike; case and
punctuation are kept; labels, language, source and doc_id are never read by the scorer.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, release
from .sampling import held_out, labelled_sample

SAMPLE_PER_CLASS = 2_500
BUCKETS = 1 << 17
DIMENSIONS = 12
NGRAMS = (3, 4)
EPOCHS = 6
BATCH = 32
RATE = 0.6
SEED = 11
#: Bytes of the words kept with their parts, in each of two generations, and of what a word takes besides its letters.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 144
THRESHOLD = 0.3
#: Feature numbers behind the buckets: a repeated word, and a text without words.
REPEATED, EMPTY = BUCKETS, BUCKETS + 1


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams between border marks."""
    letters = f"<{word.decode('utf-8', 'replace')}>"
    crc = zlib.crc32
    grams = [letters[i : i + n].encode() for n in NGRAMS for i in range(len(letters) - n + 1)]
    return [crc(b"w" + word) % BUCKETS, *[crc(g) % BUCKETS for g in grams]]


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares of all its features."""
    found = tokens(text)
    if not found:
        return np.asarray([EMPTY]), np.ones(1, np.float32)
    every = [f for w in found for f in word_features(w)] + [REPEATED] * sum(map(eq, found, found[1:]))
    ids, counts = np.unique(np.asarray(every, np.int64), return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Stochastic gradient descent; returns each feature's part of the class-1 logit, vectors and output layer multiplied out."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 2, DIMENSIONS)).astype(np.float32)
    vectors[EMPTY] = 0  # even odds unless the sample has such texts
    output = np.zeros((DIMENSIONS, 2), np.float32)
    # AdaGrad scales keep rare features learning
    seen = np.full(BUCKETS + 2, 1e-8, np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[k : k + BATCH]]
            lengths = [len(r[0]) for r in batch]
            ids, share = np.concatenate([r[0] for r in batch]), np.concatenate([r[1] for r in batch])
            owner = np.repeat(np.arange(len(batch)), lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            hidden = np.add.reduceat(vectors[ids] * share[:, None], starts, axis=0)
            logits = hidden @ output
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), [r[2] for r in batch]] -= 1
            back = p @ output.T  # gradient of each document's average
            step = rate * (1 - epoch / epochs)
            output -= step * 0.2 * (hidden.T @ p)
            part = back[owner] * share[:, None]
            norm = (part * part).sum(axis=1)
            np.add.at(seen, ids, norm)
            np.add.at(vectors, ids, -0.1 * step * part / np.sqrt(seen[ids])[:, None])
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64)


class _Parts(dict):
    """Of a word: the sum of its features' parts, and as the imaginary part their number."""

    def __init__(self, logits: np.ndarray):
        super().__init__()
        self.logits, self.old, self.room = logits, {}, CACHE_BYTES

    def __missing__(self, word: bytes) -> complex:
        value = self.old.get(word)
        if value is None:
            ids = word_features(word)
            value = complex(self.logits[ids].sum(), len(ids))
        self.room -= len(word) + ENTRY_BYTES
        if self.room < 0:
            self.old = dict(self)
            self.clear()
            self.room = CACHE_BYTES - len(word) - ENTRY_BYTES
        self[word] = value
        return value


def probability(text: bytes | None, parts: _Parts) -> float:
    found = tokens(text)
    if found:
        total = sum(map(parts.__getitem__, found))
        again = sum(map(eq, found, found[1:]))
        logit = (total.real + again * parts.logits[REPEATED]) / (total.imag + again)
    else:
        logit = parts.logits[EMPTY]
    return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> np.ndarray:
    """The model: one number a feature.  Features are taken in the tasks; the driver gets the sample's only, a part
    of the sample at a time, into one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_features(x.as_py()) for x in batch.column(0)]
            packed = [i.astype("<i4").tobytes() + w.astype("<f4").tobytes() for i, w in made]
            marks = [int.from_bytes(hashlib.blake2b(x, digest_size=7).digest()) for x in packed]
            columns = [batch.column(1), pa.array([len(i) for i, _ in made], pa.int32()), pa.array(marks, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "n", "mark", "packed"])

    sample = materialize(map_batches(labelled_sample(docs, labels, label, per_class), run, "y int, n int, mark long, packed binary"), "quality-sample")
    size = sample.agg(F.sum("n")).first()[0] or 0
    ids, share = np.empty(size, "<i4"), np.empty(size, "<f4")
    heads, at = [], 0
    for y, n, mark, packed in sample.toLocalIterator():
        ids[at : at + n], share[at : at + n] = np.frombuffer(packed, "<i4", n), np.frombuffer(packed, "<f4", n, 4 * n)
        heads.append((y, n, mark, at))
        at += n
    # the scan's order is not fixed, the training's must be
    heads.sort()
    release(sample)
    rows = [(ids[k : k + n], share[k : k + n], y) for y, n, _, k in heads]
    return train(rows) if {r[2] for r in rows} == {0, 1} else np.zeros(BUCKETS + 2)


def score(docs: DataFrame, logits: np.ndarray) -> DataFrame:
    """(doc_id, score): the probability of class 1 for every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(logits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([probability(x.as_py(), parts) for x in batch.column(1)], pa.float64())], names=["id", "score"])

    return map_batches(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", "doc_id")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; rows pass through the scorer whole."""
    logits = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(logits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(sent.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary() if not pa.types.is_large_string(batch.schema.field("text").type) else pa.large_binary())
            yield batch.filter(pa.array([probability(x.as_py(), parts) >= THRESHOLD for x in texts], pa.bool_()))

    return map_batches(docs, run, docs.schema)
