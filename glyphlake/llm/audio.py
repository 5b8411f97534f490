"""Media columns: audio payloads, their features and time spans.

A payload is stored as a mono 8-bit PCM WAV file, one byte a sample, which keeps every byte as it is.
The stored file is read back, and its samples are resampled by a polyphase filter, cut into
overlapped windows, and turned into log-mel energies; segments of sound come from two thresholds
with hysteresis on the frames' energy.  Features of a span of frames have a fixed shape, so they are
stored as fixed-shape Arrow tensors beside the span's start and end time, one Arrow stream a document.

Long payloads are worked through in pieces that overlap by the filter's and the window's reach, so
memory is bounded and the result is that of one pass.

Defined results: a null text is an empty payload; an empty payload is padded to 64 zero bytes; equal
texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

RATE_IN, RATE_OUT = 16_000, 10_000
TAPS_EACH = 8
WINDOW, HOP, MELS = 256, 128, 24
#: Frames of a tensor.
SPAN = 16
PAD = 64
#: Hysteresis in dB above the payload's quietest decile: a segment opens above the first, closes below the second.
OPEN_DB, CLOSE_DB = 3.0, 1.5
#: Output samples of a piece.
PIECE = 1 << 18
HEADER = 44


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD) if raw else bytes(PAD)


def wav_encode(payload: bytes, rate: int = RATE_IN) -> bytes:
    """Mono 8-bit PCM; a payload of odd length would get a pad byte, which multiples of 64 never need."""
    return b"RIFF" + struct.pack("<I", HEADER - 8 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_decode(stored: bytes) -> tuple[int, bytes]:
    """Sampling rate and samples, from the chunks of a WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, samples = 12, 0, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack("<I", stored[at + 4 : at + 8])[0]
        body = stored[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is kept here")
        elif name == b"data":
            samples = body
        at += 8 + size + size % 2
    if samples is None:
        raise ValueError("no samples")
    return rate, samples


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray:
    """A windowed-sinc low-pass split into its `up` phases, newest sample first."""
    n = up * TAPS_EACH
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    taps = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1]
    taps *= up / taps.sum()
    return taps.reshape(TAPS_EACH, up).T.astype(np.float32)


def resample(samples: np.ndarray, up: int, down: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """Outputs first .. first + count of the polyphase resampling by up / down; samples outside are silence."""
    total = -(-len(samples) * up // down)
    count = total - first if count is None else min(count, total - first)
    phases = _phases(up, down)
    out = np.empty(count, np.float32)
    for r in range(min(up, count)):
        # outputs r, r + up, ...: one phase, at places a fixed step apart
        k = np.arange(r, count, up, dtype=np.int64) + first
        place, phase = k[0] * down // up, int(k[0] * down % up)
        last = int(place) + (len(k) - 1) * down
        low = int(place) - TAPS_EACH + 1
        window = samples[max(0, low) : min(len(samples), last + 1)]
        window = np.pad(window, (max(0, -low), max(0, last + 1 - len(samples))))
        views = np.lib.stride_tricks.sliding_window_view(window, TAPS_EACH)[::down][: len(k)]
        out[r::up] = views @ phases[phase][::-1]
    return out


@lru_cache(maxsize=4)
def _filterbank(rate: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, over the bins of a real Fourier transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(WINDOW, 1 / rate)
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@dataclass
class Features:
    log_mel: np.ndarray  # frames x MELS, dB
    energy: np.ndarray  # frames, dB
    segments: list[tuple[int, int]]  # first and last frame

    def spans(self) -> Iterator[tuple[float, float, np.ndarray]]:
        """Start, end (seconds) and a SPAN x MELS tensor of each stretch of frames; the last is padded with the floor."""
        for k in range(0, len(self.log_mel), SPAN):
            block = self.log_mel[k : k + SPAN]
            size = len(block)
            if size < SPAN:
                block = np.concatenate([block, np.full((SPAN - size, MELS), -100.0, np.float32)])
            yield k * HOP / RATE_OUT, ((k + size - 1) * HOP + WINDOW) / RATE_OUT, block

    def digest(self, tensors: pa.Table) -> str:
        """Frames, segments and the time they cover, mean energy, and the mean log-mel spectrum of the stored tensors in whole dB."""
        held = sum(b - a + 1 for a, b in self.segments)
        mel = tensors.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, MELS)[: len(self.energy)]
        mean = mel.mean(axis=0, dtype=np.float64)
        return f"frames={len(self.energy)};segments={len(self.segments)};sound={held * HOP / RATE_OUT:.3f};energy={self.energy.mean(dtype=np.float64):.1f};mel={','.join(f'{round(float(x))}' for x in mean)}"


def hysteresis(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Stretches that rise above floor + open_db, held while they stay above floor + close_db, from end to end."""
    floor = np.quantile(energy, 0.1)
    held = energy > floor + close_db
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    peaks = np.concatenate([[0], np.cumsum(energy > floor + open_db)])
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if peaks[b] > peaks[a]]


def features(rate: int, samples: bytes) -> Features:
    common = int(np.gcd(rate, RATE_OUT))
    up, down = RATE_OUT // common, rate // common
    raw = np.frombuffer(samples, np.uint8)
    total = -(-len(raw) * up // down)
    frames = 1 + max(0, -(-(total - WINDOW) // HOP))
    bank, hann = _filterbank(RATE_OUT), np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    mels, energies = [], []
    each = PIECE // HOP
    for k in range(0, frames, each):
        n = min(each, frames - k)
        first, need = k * HOP, (n - 1) * HOP + WINDOW
        # only the samples that this piece's outputs reach are made floats
        low = max(0, first * down // up - TAPS_EACH)
        low -= low % down
        high = min(len(raw), (first + need) * down // up + 2)
        part = (raw[low:high].astype(np.float32) - 128) / 128
        begin = first - low // down * up
        sound = resample(part, up, down, begin, need)
        sound = np.pad(sound, (0, need - len(sound)))
        views = np.lib.stride_tricks.sliding_window_view(sound, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(views * hann, axis=1)).astype(np.float32) ** 2
        mels.append(10 * np.log10(power @ bank + 1e-10))
        energies.append(10 * np.log10(np.var(views, axis=1) + 1e-10))  # without the constant part
    energy = np.concatenate(energies)
    return Features(np.concatenate(mels), energy, hysteresis(energy))


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (SPAN, MELS))


def tensor_table(found: Features) -> pa.Table:
    """(start_s, end_s, log_mel): a row a span, with log_mel a column of fixed-shape tensors."""
    spans = list(found.spans())
    values = np.stack([t for _, _, t in spans]).astype(np.float32)
    return pa.table({"start_s": [s for s, _, _ in spans], "end_s": [e for _, e, _ in spans], "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(values)})


def tensors_encode(table: pa.Table) -> bytes:
    """An Arrow stream, which keeps the tensors' type and shape."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def tensors_decode(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def media(docs: DataFrame, *, with_file: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: the payload's and the stored file's digests, the feature string and the stored tensors with
    their time spans, from which it is made; the file itself if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("tensors", "binary")] + [("media", "binary")] * with_file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for text in batch.column(1):
                raw = text.as_py() or b""
                stored = wav_encode(padded(raw))
                rate, back = wav_decode(stored)
                found = features(rate, back)
                tensors = tensors_encode(tensor_table(found))
                row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), found.digest(tensors_decode(tensors)), tensors] + [stored] * with_file
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, kinds[k]) for v, (_, k) in zip(out, fields, strict=True)]], names=["id", *[n for n, _ in fields]])

    schema = f"id {kind}, " + ", ".join(f"{n} {k}" for n, k in fields)
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), run, schema).withColumnRenamed("id", id_col)


def spans(files: DataFrame, *, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id, span, start_s, end_s, sound, log_mel) of stored files: log_mel is a tensor of SPAN x MELS numbers, row by row."""
    kind = files.schema[id_col].dataType.simpleString()
    names = ["id", "span", "start_s", "end_s", "sound", "log_mel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, stored in zip(batch.column(0), batch.column(1), strict=True):
                found = features(*wav_decode(stored.as_py()))
                held = np.zeros(len(found.energy) + SPAN, bool)
                for a, b in found.segments:
                    held[a : b + 1] = True
                rows = [(k, s, e, float(held[k * SPAN : (k + 1) * SPAN].mean()), t.ravel()) for k, (s, e, t) in enumerate(found.spans())]
                kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), batch.column(0).type), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=names)

    schema = f"id {kind}, span int, start_s double, end_s double, sound double, log_mel array<float>"
    return map_batches(files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), run, schema).withColumnRenamed("id", id_col)
