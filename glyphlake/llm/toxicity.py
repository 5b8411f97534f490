"""Toxic passages by maximum-scoring segments.

Words get log-odds of standing in toxic against clean documents, under an informative Dirichlet prior
taken from the whole sample, less a margin of their standard deviation.  A word without evidence of
its own backs off to its longest beginning that has some.  Near copies in the sample count once, so
that a toxic text's many copies do not make all its words evidence.  Along a text, words score their log-odds
less a constant drift; the linear-time scan for all maximal scoring segments then returns every
passage that is toxic beyond its surroundings.  Chance passages follow an extreme-value law with
parameters lambda and K, fitted on clean documents; a passage's bits are its score in that law's
units against the length searched.  A logistic curve over the best passage's and the summed bits,
fitted on documents that the weights were not learned from, turns them into a score between 0 and 1.

Defined results: a null or empty text has no passage and gets the score of none; copies score alike;
labels, language, source and doc_id are never read by the scorer.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .sampling import held_out, labelled_sample

#: Documents a class that the word statistics are learned from.
SAMPLE_PER_CLASS = 12_000
#: Documents that a word or beginning must stand in to get log-odds.
MIN_DOCS = 4
#: Documents of each class that the last third needs to be kept from the weights.
LEAST_HELD = 100
#: The prior counts as this share of the sample's documents.
PRIOR_SHARE = 0.04
MARGIN = 3.0
#: Log-odds, after the margin, below which a word is not evidence; above which one may still be.
LEAST = 0.5
DRIFT = 0.2
BEGINNINGS = (6, 5, 4)
IDLE_SHARE = 0.9
#: Strongest features kept; the model that is sent to the tasks is bounded by them.
MAX_FEATURES = 200_000
CACHE_WORDS = 400_000

#: ASCII bytes other than letters become spaces.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split() if text else []


def beginnings(word: bytes) -> list[bytes]:
    letters = word.decode("utf-8", "replace")
    return [b"^" + letters[:n].encode() for n in BEGINNINGS if len(letters) >= n]


@dataclass
class Segments:
    """All maximal scoring segments of a sequence, by the published linear-time scan."""

    found: list[tuple[int, int, float]] = field(default_factory=list)

    @classmethod
    def of(cls, scores: np.ndarray) -> Segments:
        """Runs over the positive scores only; what lies between two of them is one step."""
        places = np.flatnonzero(scores > 0)
        if not len(places):
            return cls()
        total = np.concatenate([[0.0], np.cumsum(scores)])
        stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum through
        for p in places.tolist():
            first, last, low, high = p, p, float(total[p]), float(total[p + 1])
            while True:
                k = len(stack) - 1
                while k >= 0 and stack[k][2] >= low:
                    k -= 1
                if k < 0 or stack[k][3] >= high:
                    break
                first, low = stack[k][0], stack[k][2]
                del stack[k:]
            stack.append((first, last, low, high))
        return cls([(a, b, high - low) for a, b, low, high in stack])


class _Scores(dict):
    """Score of a word, with the drift; words without evidence take their longest known beginning's."""

    def __init__(self, features: dict[bytes, float], drift: float):
        super().__init__()
        self.features, self.drift = features, drift

    def __missing__(self, word: bytes) -> float:
        score = self.features.get(word)
        if score is None:
            score = next((s for s in map(self.features.get, beginnings(word)) if s is not None), 0.0)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = score - self.drift
        return score - self.drift


@dataclass
class Model:
    features: dict[bytes, float]
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] = (-2.0, 0.5, 0.0)

    def __post_init__(self):
        self.scores = _Scores(self.features, DRIFT)

    def __getstate__(self):
        return {"features": self.features, "lam": self.lam, "k": self.k, "curve": self.curve}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.scores = _Scores(self.features, DRIFT)

    def segments(self, text: bytes | None) -> tuple[list[bytes], list[tuple[int, int, float]]]:
        found = tokens(text)
        if not found:
            return found, []
        return found, Segments.of(np.fromiter(map(self.scores.__getitem__, found), np.float64, len(found))).found

    def bits(self, score: float, n: int) -> float:
        """A segment's score in units of the law of chance segments of n words, at least 0."""
        return max(0.0, (self.lam * score - np.log(max(self.k * n, 1e-12))) / np.log(2.0))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        each = sorted((self.bits(s, n) for _, _, s in found), reverse=True)
        return (np.log1p(each[0]), np.log1p(sum(each))) if each else (0.0, 0.0)

    def probability(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-(a + b * evidence[0] + c * evidence[1]))))


def _without_copies(sample: DataFrame) -> DataFrame:
    """One document of those whose least hash of four words in a row is the same, as near copies mostly have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for text in batch.column(0):
                found = tokens(text.as_py())
                marks.append(min((zlib.crc32(b" ".join(g)) for g in zip(found, found[1:], found[2:], found[3:], strict=False)), default=zlib.crc32(b" ".join(found))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=["text", "y", "mark"])

    return map_batches(sample, run, "text binary, y int, mark long").groupBy("mark", "y").agg(F.min("text").alias("text")).select("text", "y")


def _word_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of either class with the word or beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array([counts[y][k] for k in keys], pa.int64()) for y in (1, 0)]], names=["feature", "toxic", "clean"])

        counts = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = set(tokens(text.as_py()))
                counts[y].update(own)
                counts[y].update({b for w in own for b in beginnings(w)})
                if len(counts[0]) + len(counts[1]) > CACHE_WORDS:
                    yield flush(counts)
                    counts = (Counter(), Counter())
        yield flush(counts)

    part = map_batches(sample, run, "feature binary, toxic long, clean long")
    return part.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= MIN_DOCS)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, share: float = PRIOR_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each feature with an informative Dirichlet prior, and their standard deviations."""
    prior = share * (n_toxic + n_clean)
    alpha = share * (toxic + clean)
    a, b = toxic + alpha, clean + alpha
    delta = np.log(a / (n_toxic + prior - a)) - np.log(b / (n_clean + prior - b))
    return delta, np.sqrt(1 / a + 1 / b)


def _idle(names: list[bytes], toxic: np.ndarray) -> list[bool]:
    """Beginnings that owe their toxic documents to one longer beginning or word, which speaks for itself."""
    number = {n: i for i, n in enumerate(names)}
    idle = [False] * len(names)
    for name, n in zip(names, toxic.tolist(), strict=True):
        whole = not name.startswith(b"^")
        for short in beginnings(name if whole else name[1:]):
            k = number.get(short)
            if k is not None and short != name and n >= IDLE_SHARE * toxic[k]:
                idle[k] = True
    return idle


def solve_lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 for a score distribution of negative mean; 1 if it has none."""
    weight = counts / max(1.0, counts.sum())
    if not len(scores) or scores.max() <= 0 or (weight * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (weight * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    low = 1e-6
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return max(0.05, min(low, 20.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method for ridge logistic regression; the first column is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Word weights from two thirds of the sample; the law of chance segments and the curve from the last third, which
    the weights don't know, unless that third has few documents of a class."""
    whole = materialize(_without_copies(labelled_sample(docs, labels, label, per_class)), "toxicity-sample")
    third = F.pmod(F.crc32("text"), F.lit(3)) == 0
    counts = whole.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(third.cast("int")).alias("k")).collect()
    split = len(counts) == 2 and all(r["k"] >= LEAST_HELD for r in counts)
    sample, held = (whole.where(~third), whole.where(third)) if split else (whole, whole)
    sizes = {r["y"]: r["n"] - (r["k"] if split else 0) for r in counts}
    if not sizes.get(0) or not sizes.get(1):
        return Model({})
    counted = _word_counts(sample).toArrow()
    toxic, clean = (counted.column(c).to_numpy().astype(float) for c in ("toxic", "clean"))
    delta, spread = log_odds(toxic, clean, float(sizes[1]), float(sizes[0]))
    low, high = delta - MARGIN * spread, delta + MARGIN * spread
    weights = np.where(low >= LEAST, low, 0.0)
    names = counted.column("feature").to_pylist()
    weights[[i for i, idle in enumerate(_idle(names, toxic)) if idle]] = 0.0
    # words known to be harmless are kept with weight 0, as they stop the backing off; doubtful ones are not
    sure = np.flatnonzero((weights > 0) | (high < 1.0))
    keep = sure[np.lexsort((-(toxic + clean)[sure], -weights[sure]))][:MAX_FEATURES]
    model = Model({names[i]: float(weights[i]) for i in keep})
    # the law of chance segments, on clean documents
    rows = _segment_rows(held, model)
    clean_rows = [r for r in rows if r[0] == 0]
    hist = Counter()
    for r in clean_rows:
        hist.update(r[3])
    model.lam = solve_lambda(np.asarray(list(hist), float), np.asarray(list(hist.values()), float))
    chance = sum(r[1] * np.exp(-model.lam * max(r[2], default=0.0)) for r in clean_rows)
    model.k = len(clean_rows) / max(chance, 1e-9)
    x = np.asarray([(1.0, *model.evidence([(0, 0, s) for s in r[2]], r[1])) for r in rows])
    model.curve = tuple(map(float, logistic(x, np.asarray([float(r[0]) for r in rows]))))
    return model


def _segment_rows(sample: DataFrame, model: Model) -> list[tuple[int, int, list[float], dict[float, int]]]:
    """Of each sampled document: class, words, segment scores, and how often each rounded word score stands in it."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = tokens(text.as_py())
                scores = np.fromiter(map(model.scores.__getitem__, found), np.float64, len(found))
                values, counts = np.unique(np.round(scores, 1), return_counts=True)
                out.append((y, len(found), [s for _, _, s in Segments.of(scores).found], values.tolist(), counts.tolist()))
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["y", "n", "s", "v", "c"])

    rows = map_batches(sample, run, "y int, n long, s array<double>, v array<double>, c array<long>").toArrow().to_pylist()
    return [(r["y"], r["n"], r["s"], dict(zip(r["v"], r["c"], strict=True))) for r in rows]


def score(docs: DataFrame, model: Model, *, with_passages: bool = False) -> DataFrame:
    """(doc_id, score, best_bits, n_passages[, passages]) of whole texts; passages are word spans with their text's words and bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("bits", pa.float64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, best, many, spans = [], [], [], []
            for text in batch.column(1):
                found, segments = model.segments(text.as_py())
                real = [(a, b, model.bits(s, len(found))) for a, b, s in segments]
                real = [x for x in real if x[2] > 0]
                scores.append(model.probability(model.evidence(segments, len(found))))
                best.append(max((x[2] for x in real), default=0.0))
                many.append(len(real))
                if with_passages:
                    spans.append([{"first": a, "last": b, "bits": bits, "words": b" ".join(found[a : b + 1]).decode()} for a, b, bits in real])
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(best, pa.float64()), pa.array(many, pa.int64())]
            names = ["id", "score", "best_bits", "n_passages"]
            if with_passages:
                columns.append(pa.array(spans, pa.list_(passage)))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = f"id {kind}, score double, best_bits double, n_passages long" + (", passages array<struct<first:long,last:long,bits:double,words:string>>" if with_passages else "")
    return map_batches(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")), run, fields).withColumnRenamed("id", "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "best_bits", "n_passages")
