"""Token counts by prefix dynamic programming.

A byte-pair encoding is closed under prefixes: if a text's encoding ends in token t, dropping t
leaves the encoding of the rest.  So the encoding of every prefix is the encoding of a shorter
prefix plus one last token, and that token is the only vocabulary suffix that stands next to the
shorter prefix's last token without the two merging otherwise.  One pass over a text therefore
gives the exact count at every prefix, and truncation or budget questions need no encoding.

The vocabulary also tells which character classes never meet inside a piece; a text is cut there
and the tables of the cut units are cached, as natural text repeats them.

Defined results: null and empty texts have 0 tokens and an empty table; rows are never merged,
so repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Units whose tables a worker keeps; then it starts anew.
CACHE_UNITS = 400_000
CACHE_PAIRS = 1_000_000


class PrefixCounter:
    """Exact token counts at all prefixes for a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        # a piece's rank: the smaller is merged the earlier
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        # beginnings of pieces: true if one is a piece itself
        self._begins = {p[:k]: False for p in self.rank for k in range(1, len(p))} | dict.fromkeys(self.rank, True)
        self._units = re.compile(self._unit_pattern())
        self._pairs: dict[tuple[str, str], bool] = {}
        self._split: dict[str, tuple[str, str]] = {}
        self._tables = _Cache(self._table)
        self._totals = _Cache(lambda unit: self._counts(unit)[-1])

    def _unit_pattern(self) -> str:
        """Units end where no piece goes on: before a word mark, around characters outside the vocabulary's
        alphabet, and between letters and others, counting the few letters that pieces join to others as such."""
        outside = re.escape("".join(chr(c) for c in [*range(32), 127] if chr(c) not in self.rank))
        pairs = {(a, b) for p in self.rank for a, b in zip(p, p[1:], strict=False)}
        if any(b == MARK != a for a, b in pairs):
            return r"(?s).+"
        exempt: set[str] = set()
        letter = lambda c: bool(re.match(r"[^\W\d_]", c)) and c not in exempt
        while more := {a if letter(a) else b for a, b in pairs if a != MARK and letter(a) != letter(b)}:
            exempt |= more
            if len(exempt) > 50:
                return f"{MARK}*[^{MARK}{outside}]+|{MARK}+|[{outside}]"
        apart = re.escape("".join(sorted(exempt)))
        letters = rf"[^\W\d_{apart}]"
        return rf"{MARK}*(?:{letters}+|(?:(?!{letters})[^{MARK}{outside}])+)|{MARK}+|[{outside}]"

    def merge(self, text: str) -> list[str]:
        """The plain encoding of a short text: merge the best adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: str) -> tuple[str, str] | None:
        """What the last merge that made the token joined; None for one character, ("", "") if no merges make it."""
        known = self._split.get(token)
        if known is None and len(token) > 1:
            parts = list(token)
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
                at = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[at] == np.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else ("", "")
        return known

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two tokens when they are merged side by side.

        Runs the merges backwards: of the two tokens at the border the one made later is split, and a piece over
        the border must not be due before that merge.  A tie goes to the left one, as merging does.
        """
        due = (np.inf, 0)
        rank = self.rank
        while True:
            joined = rank.get(left + right)
            if joined is not None and (joined, 0) < due:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] > rank[right]):
                due, left = (rank[left], 0), a[1]
            else:
                due, right = (rank[right], 1), b[0]

    def _stands(self, left: str, token: str) -> bool:
        key = (left, token)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._halves(token) != ("", "") and (not left or self._apart(left, token))
        return known

    def _counts(self, unit: str) -> list[int]:
        """Token counts of the unit's prefixes.  Exactly one piece ends the encoding of each prefix."""
        n = len(unit)
        last, count = [""] * (n + 1), [0] * (n + 1)
        begins, pairs, stands = self._begins.get, self._pairs.get, self._stands
        for i in range(n):
            left, more = last[i], count[i] + 1
            for j in range(i + 1, n + 1):
                token = unit[i:j]
                piece = begins(token)
                if piece is None:
                    break
                if piece and not count[j]:
                    fits = pairs((left, token))
                    if stands(left, token) if fits is None else fits:
                        last[j], count[j] = token, more
            if not count[i + 1]:  # not in the vocabulary: bytes, which merge with nothing
                count[i + 1] = count[i] + len(unit[i].encode("utf-8", "surrogatepass"))
        return count

    def _table(self, unit: str) -> bytes:
        """Differences of successive prefix counts, one signed byte a character."""
        count = self._counts(unit)
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:], strict=False)])

    def units(self, text: str) -> list[str]:
        return self._units.findall(MARK + text.replace(" ", MARK)) if text else []

    def table(self, text: str) -> bytes:
        """Differences of the counts at prefixes of 0, 1, 2 ... characters behind the word mark; empty for an empty text."""
        return b"".join(map(self._tables.__getitem__, self.units(text)))

    def count(self, text: str) -> int:
        return sum(map(self._totals.__getitem__, self.units(text)))


class _Cache(dict):
    """Values by unit; of more than CACHE_UNITS it keeps those used since it was last full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(self) >= CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


def counts_at(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 ... characters; the empty prefix has none."""
    counts = np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)
    if len(counts):
        counts[0] = 0
    return counts if len(counts) else np.zeros(1, np.int64)


def longest_prefix(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    return int(np.flatnonzero(counts_at(table) <= budget)[-1])


@lru_cache(maxsize=4)
def counter(model_file: str | None) -> PrefixCounter:
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path(DEFAULT_MODEL)
    return PrefixCounter(model_file)


def prefix_token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, limit: int = 4096, with_table: bool = False) -> DataFrame:
    """Token counts of whole texts: id, n_bytes, n_tokens, over_limit and, if asked for, prefix_table.

    prefix_table holds what counts_at() and longest_prefix() read.  Tokenizer files are read where the
    tasks run, by path; no row moves between tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean" + (", prefix_table binary" if with_table else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(model_file)
        for batch in batches:
            texts, tables, counts, sizes = batch.column(1), [], [], []
            for value in texts:
                raw = value.as_py() or b""
                text = raw.decode("utf-8", "replace")
                sizes.append(len(raw))
                if with_table:
                    tables.append(known.table(text))
                    counts.append(int(np.frombuffer(tables[-1], np.int8).sum(dtype=np.int64)))
                else:
                    counts.append(known.count(text))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            names = ["id", "n_bytes", "n_tokens", "over_limit"]
            if with_table:
                columns.append(pa.array(tables, pa.binary()))
                names.append("prefix_table")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, fields)
    return out.withColumnRenamed("id", id_col)
