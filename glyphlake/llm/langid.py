"""Language identification with a linear-chain conditional random field.

Words of a text form a chain whose labels are languages.  A word's emission scores come from hashed
features: its beginnings and endings, character n-grams, and itself if it is in the lexicon of
frequent words learned from the sample.  Transitions between the languages of neighbouring words are
learned with them, by gradient ascent on the conditional likelihood; the training chains join pieces
of documents in different languages, so that switching is seen.  A text is labelled by the
forward-backward marginals of its words, and its language is the one with the greatest share.

Chains are evaluated many at a time: they are laid end to end with a transition that forgets what was
before, cut into blocks, and the blocks' transfer matrices are multiplied for all blocks at once; so
the result is that of each chain on its own.  A text too long for memory is one chain as well: messages
pass between its parts.  Shares are rounded, so a text scores the same whatever stands beside it.

Defined results: `und` with score 0 if a text is null or has no letter; copies score alike; lang is
read only for the labels of documents that are not held out, source and doc_id never.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, map_batches
from .sampling import held_out, spread_hash

FOLDS, HELD_OUT = 4, 2
#: Documents a language that are learned from, with their whole texts.
SAMPLE_PER_LANG = 400
BUCKETS = 1 << 16
MASK = BUCKETS - 1
LEXICON = 300
CHAIN = 40
BATCH = 64
EPOCHS = 4
RATE = 0.15
SEED = 5
BLOCK = 256
#: Words whose marginals are in memory at a time: whole texts, or a part of a longer one. A number of whole blocks.
CHUNK_WORDS = 800 * BLOCK
CACHE_WORDS = 600_000
#: Scores are rounded to this, so that the order of additions does not show.
DECIMALS = 6
#: New words whose features are summed together.
NEW_WORDS = 20_000
WORD = re.compile(r"[^\W\d_]+")


def tokens(text: bytes | None) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower()) if text else []


def word_features(word: str, lexicon: set[str]) -> list[int]:
    """Buckets of a word's beginnings, endings and n-grams, in UTF-8; the kinds start their checksums differently."""
    crc, raw = zlib.crc32, word.encode("utf-8", "surrogatepass")
    n = len(raw)
    found = [crc(raw[:1], 1), crc(raw[:2], 1), crc(raw[:3], 1), crc(raw[-1:], 2), crc(raw[-2:], 2), crc(raw[-3:], 2)]
    found += [crc(raw[i : i + 2], 3) for i in range(n - 1)]
    found += [crc(raw[i : i + 3], 3) for i in range(n - 2)]
    if word in lexicon:
        found.append(crc(raw, 4))
    return [x & MASK for x in found]


class _Blocks:
    """Chains laid end to end and cut into blocks, with the moves of one word in all blocks at once."""

    def __init__(self, emission: np.ndarray, starts: np.ndarray, transition: np.ndarray, first: np.ndarray):
        total, labels = emission.shape
        self.count, self.transition, self.first = -(-total // BLOCK), transition, first
        width = self.count * BLOCK
        e = np.ones((width, labels))
        e[:total] = emission
        fresh = np.ones(width, bool)
        fresh[:total] = starts
        self.e, self.fresh = e.reshape(self.count, BLOCK, labels), fresh.reshape(self.count, BLOCK)

    def step(self, state: np.ndarray, t: int) -> np.ndarray:
        """One word further for states of shape (blocks, ..., labels)."""
        moved = state @ self.transition
        new = self.fresh[:, t]
        if new.any():
            moved[new] = state[new].sum(axis=-1, keepdims=True) * self.first
        moved *= self.e[:, t].reshape(self.count, *[1] * (state.ndim - 2), self.e.shape[2])
        return moved

    def transfers(self) -> np.ndarray:
        """What each block does to a state, up to a factor."""
        labels = self.e.shape[2]
        transfer = np.broadcast_to(np.eye(labels), (self.count, labels, labels)).copy()
        for t in range(BLOCK):
            transfer = self.step(transfer, t)
            transfer /= transfer.sum(axis=(1, 2), keepdims=True)
        return transfer


def chain_transfer(emission: np.ndarray, starts: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What some words do to a state, up to a factor."""
    out = np.eye(emission.shape[1])
    for transfer in _Blocks(emission, starts, transition, first).transfers():
        out = out @ transfer
        out /= out.sum()
    return out


def chain_marginals(emission: np.ndarray, starts: np.ndarray, transition: np.ndarray, first: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward marginals of chains laid end to end: emission and first are positive factors, starts marks
    the chains' first words.  enter and leave are the messages into a part of a chain from what is before and behind it;
    a part with more behind it must fill its blocks."""
    total, labels = emission.shape
    cut = _Blocks(emission, starts, transition, first)
    blocks, e, fresh = cut.count, cut.e, cut.fresh
    transfer = cut.transfers()
    into = np.empty((blocks, labels))
    state = np.full(labels, 1 / labels) if enter is None else enter
    for b in range(blocks):
        into[b] = state
        state = state @ transfer[b]
        state = state / state.sum()
    after = np.empty((blocks, labels))
    state = np.full(labels, 1 / labels) if leave is None else leave
    for b in range(blocks - 1, -1, -1):
        after[b] = state
        state = transfer[b] @ state
        state = state / state.sum()
    alpha = np.empty((BLOCK, blocks, labels))
    state = into
    for t in range(BLOCK):
        state = cut.step(state, t)
        state = state / state.sum(axis=1, keepdims=True)
        alpha[t] = state
    beta = after
    for t in range(BLOCK - 1, -1, -1):
        alpha[t] *= beta
        weighted = beta * e[:, t]
        back = weighted @ transition.T
        new = fresh[:, t]
        if new.any():
            back[new] = (weighted[new] @ first)[:, None]
        beta = back / back.sum(axis=1, keepdims=True)
    out = alpha.transpose(1, 0, 2).reshape(blocks * BLOCK, labels)[:total]
    return out / out.sum(axis=1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    transition: np.ndarray  # logs
    first: np.ndarray  # logs
    lexicon: set[str]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission factors of words, scaled to at most 1."""
        feats = [word_features(w, self.lexicon) for w in words]
        starts = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
        score = np.add.reduceat(self.weights[np.fromiter(chain.from_iterable(feats), np.int64)], starts, axis=0)
        return np.exp(np.clip(score - score.max(axis=1, keepdims=True), -60, 0))


class _Numbers(dict):
    """Words numbered in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Labeller:
    """Marginals of many texts, with the emission factors of known words kept."""

    def __init__(self, model: Model):
        self.model, self.transition, self.first = model, np.exp(model.transition), np.exp(model.first)
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.rows = np.empty((0, len(self.model.langs)))

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """For each text (a non-empty word list) the mean marginal of each language."""
        known = len(self.numbers)
        ids = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64)
        if len(self.numbers) > known:
            new = list(islice(self.numbers, known, None))
            parts = [self.model.emissions(new[k : k + NEW_WORDS]) for k in range(0, len(new), NEW_WORDS)]
            self.rows = np.concatenate([self.rows[:known], *parts])
        lengths = np.asarray([len(t) for t in texts])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        sums = np.zeros((len(texts), len(self.model.langs)))
        lo = 0
        while lo < len(texts):
            # as many whole texts as fit; a longer one is worked through by itself
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK_WORDS, side="right")) - 1)
            part = ids[bounds[lo] : bounds[hi]]
            if len(part) > CHUNK_WORDS:
                sums[lo] = self._long(part)
            else:
                starts = np.zeros(len(part), bool)
                starts[bounds[lo:hi] - bounds[lo]] = True
                marginal = chain_marginals(self.rows[part], starts, self.transition, self.first)
                sums[lo:hi] = np.add.reduceat(marginal, bounds[lo:hi] - bounds[lo], axis=0)
            lo = hi
        if len(self.numbers) > CACHE_WORDS:
            self.clear()
        return np.round(sums / lengths[:, None], DECIMALS)

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Sums of the marginals of one chain, a part in memory at a time: messages between the parts come first."""
        parts = [ids[k : k + CHUNK_WORDS] for k in range(0, len(ids), CHUNK_WORDS)]
        starts = np.zeros(CHUNK_WORDS, bool)
        starts[0] = True
        marks = [starts if k == 0 else np.zeros(CHUNK_WORDS, bool) for k in range(len(parts))]
        moves = [chain_transfer(self.rows[p], m[: len(p)], self.transition, self.first) for p, m in zip(parts, marks, strict=True)]
        even = np.full(len(self.model.langs), 1 / len(self.model.langs))
        enter, leave = [even], [even]
        for move in moves[:-1]:
            enter.append(enter[-1] @ move / (enter[-1] @ move).sum())
        for move in moves[:0:-1]:
            leave.append(move @ leave[-1] / (move @ leave[-1]).sum())
        found = zip(parts, marks, enter, leave[::-1], strict=True)
        return sum(chain_marginals(self.rows[p], m[: len(p)], self.transition, self.first, a, z).sum(axis=0) for p, m, a, z in found)


def train(samples: list[tuple[int, list[str]]], langs: list[str], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """AdaGrad on the conditional likelihood of chains that switch between documents of different languages."""
    rng = np.random.default_rng(seed)
    n = len(langs)
    counts = [Counter() for _ in langs]
    for lang, words in samples:
        counts[lang].update(words)
    lexicon = {w for c in counts for w, _ in c.most_common(LEXICON)}
    pieces: list[tuple[int, list[str]]] = []
    for lang, words in samples:
        at = 0
        while at < len(words):
            size = int(rng.integers(4, CHAIN))
            pieces.append((lang, words[at : at + size]))
            at += size
    known = {w: np.asarray(word_features(w, lexicon)) for w in {w for _, p in pieces for w in p}}
    model = Model(langs, np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n), lexicon)
    scale_w, scale_t, scale_f = np.full((BUCKETS, n), 1e-2), np.full((n, n), 1e-2), np.full(n, 1e-2)
    for _ in range(epochs):
        words, gold = [], []
        for k in rng.permutation(len(pieces)):
            words += pieces[k][1]
            gold += [pieces[k][0]] * len(pieces[k][1])
        chains = [(words[k : k + CHAIN], gold[k : k + CHAIN]) for k in range(0, len(words) - CHAIN + 1, CHAIN)] or [(words, gold)]
        for k in range(0, len(chains), BATCH):
            batch = chains[k : k + BATCH]
            length = len(batch[0][0])
            feats = [known[w] for c, _ in batch for w in c]
            sizes = np.asarray([len(f) for f in feats])
            flat = np.concatenate(feats)
            word_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            emission = np.add.reduceat(model.weights[flat], word_starts, axis=0).reshape(len(batch), length, n)
            y = np.asarray([g for _, g in batch])
            marginal, pair = _expectations(emission, model.transition, model.first)
            observed = np.eye(n)[y]
            gain = observed - marginal
            each = np.repeat(gain.reshape(-1, n), sizes, axis=0) / len(batch)
            grad_w = np.zeros_like(model.weights)
            for lang in range(n):
                grad_w[:, lang] = np.bincount(flat, weights=each[:, lang], minlength=BUCKETS)
            grad_t = (np.einsum("bti,btj->ij", observed[:, :-1], observed[:, 1:]) - pair) / len(batch) - 1e-3 * model.transition
            grad_f = gain[:, 0].sum(axis=0) / len(batch) - 1e-3 * model.first
            for value, grad, scale in ((model.weights, grad_w, scale_w), (model.transition, grad_t, scale_t), (model.first, grad_f, scale_f)):
                scale += grad * grad
                value += rate * grad / np.sqrt(scale)
    return model


def _expectations(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and the expected number of each transition, for chains of equal length."""
    batch, length, n = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    a = np.exp(transition - transition.max())
    alpha = np.empty((length, batch, n))
    state = np.exp(first - first.max()) * e[:, 0]
    alpha[0] = state / state.sum(axis=1, keepdims=True)
    for t in range(1, length):
        state = (alpha[t - 1] @ a) * e[:, t]
        alpha[t] = state / state.sum(axis=1, keepdims=True)
    beta = np.full((batch, n), 1 / n)
    marginal = np.empty((batch, length, n))
    pair = np.zeros((n, n))
    for t in range(length - 1, -1, -1):
        m = alpha[t] * beta
        marginal[:, t] = m / m.sum(axis=1, keepdims=True)
        weighted = beta * e[:, t]
        if t:
            joint = alpha[t - 1][:, :, None] * a[None] * weighted[:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = weighted @ a.T
        beta /= beta.sum(axis=1, keepdims=True)
    return marginal, pair


def fit(docs: DataFrame, *, per_lang: int = SAMPLE_PER_LANG) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0), set())
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / counts[k])))]), F.col("lang"))
    picked = known.where(spread_hash("doc_id", "langid") < share).select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [tokens(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])

    rows = map_batches(picked, run, "lang string, words array<string>").toArrow().to_pylist()
    number = {k: i for i, k in enumerate(langs)}
    samples = sorted((number[r["lang"]], r["words"]) for r in rows if r["words"])
    return train(samples, langs) if samples else Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0), set())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, shares): the score is the share of the predicted language's marginals."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        labeller = Labeller(model) if model.langs else None

        def flush(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            full = [k for k, t in enumerate(texts) if t]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if labeller and full:
                shares = labeller.shares([texts[k] for k in full])
                for k, row in zip(full, shares, strict=True):
                    names[k], scores[k] = model.langs[int(row.argmax())], float(min(1.0, row.max()))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind_arrow), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

        ids, texts, size, kind_arrow = [], [], 0, None
        for batch in batches:
            kind_arrow = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens(text.as_py())
                ids.append(key)
                texts.append(words)
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    return map_batches(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", "doc_id")


def language(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs)).select("doc_id", held_out(HELD_OUT, FOLDS).alias("held_out"), "lang_pred", "score")
