"""Near copies: texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

SimHash anchors (see simhash) bring together the texts whose fingerprints differ in at most 3 bits.  Texts of
similarity 0.8 differ in about ten of 64 bits, which no covering of affordable size spans, so what the anchors
leave apart is joined exactly: shingles have one order for all texts, and of two sets of similarity t each leaves
at most a share 1 - t of its shingles unshared, so among the first n - ceil(t n) + 1 of each there is a shared one.
Texts meet at these first shingles.  Any order is right; shingles that a bounded sample of texts repeats come last,
so that common lines and passages bring few texts together.  Every candidate, of anchors and shingles alike, is
verified by the two whole sets, so all pairs of that similarity are linked and no others.

A text is a node, once for each task that reads it; equal texts of a task share a node, equal nodes of several
tasks are linked by their 128-bit names.  Candidates are narrowed before sets are moved: parity bits (how often
shingles hash to a bit, modulo 2) of two sets differ in at most as many bits as the sets differ in shingles, so they
never rule out a pair that is similar enough.  In a first round each node is verified with the nearest of the least
nodes it met, which joins most groups with one set moved a node.  Only what still has different labels at a shingle
is compared, in chunks by separate tasks, and the pairs that parity bits leave are verified.  At shingles with many
such pairs rounds verify each label's best pair first, which joins what is left of large groups; what is of different
labels even then is verified pair by pair.  Shingles that the sample shows to be frequent are dealt over several tasks from the start, with a
center each.  Joins by label are left to Spark's splitting of skewed joins.

Defined results: null and empty texts, and those of white space, have no shingles and are one group; a
text of fewer words than a shingle is one shingle; repeated rows are one group; a null id is in a group
but never its id unless all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, materialize, release
from .simhash import CHUNK, components, majority
from .simhash import links as anchor_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Texts whose repeated shingles are put last, and how many of these shingles at most.
SAMPLE, COMMON = 4000, 1 << 16
#: Parity bits of a node at least; there are twice as many as shingles.
PARITY = 1024
#: Pairs a row, beyond which a shingle's pairs are verified in rounds, and how many such rounds there are.
MOST_PAIRS, ROUNDS = 4, 3
#: Nodes that a task remembers to tell that a text has come again.
SEEN = 1 << 18
#: Bits of the sieve of texts whose sets are needed.
SIEVE = 1 << 22
#: Sets that are compared with one center by one task.
SPOKES = 64


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_AZ).split()


def name_of(tokens: list[bytes]) -> bytes:
    """128 bits that stand for a text's words."""
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(tokens), SEED)


def shingle_hashes(tokens: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle, repeats included."""
    import xxhash

    if not tokens:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(tokens)] if len(tokens) < shingle else map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, max(1, len(tokens) - shingle + 1))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The text's distinct shingles by their hashes as signed longs, sorted."""
    return np.sort(np.unique(shingle_hashes(words(text), shingle)).view(np.int64))


def parity(found: np.ndarray) -> bytes:
    """For each residue whether an odd number of shingles has it; the width is a power of two."""
    width = max(PARITY, 1 << math.ceil(math.log2(max(1, 2 * len(found)))))
    flips = np.bincount((found.view(np.uint64) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """Parity bits of a smaller width, as longs."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 64), axis=0)


def apart(x: bytes, y: bytes) -> int:
    """Bits that differ in the smaller width of two."""
    width = 8 * min(len(x), len(y))
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64))


def meeting_width(n: int) -> int:
    """Parity bits that a node of n shingles takes along to each: enough to tell unlike sets, fewer than it has."""
    return 1 << max(8, min(12, math.ceil(math.log2(max(1, n)))), math.ceil(math.log2(max(1, n / 2))))


def most_apart(n: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles two sets of n in all may differ."""
    return n * ((1 - similarity) / (1 + similarity)) + 1e-6


def first_shingles(found: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The set's first shingles, of which every set that is similar enough has one among its own first."""
    late = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        late = np.where(common[at] == found, rank[at] + 1, 0)
    return found[np.lexsort((found, late))][: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1] if len(found) else found


def common_shingles(docs: DataFrame, shingle: int, text_col: str, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample have, sorted; their ranks, the most common last; and over how
    many tasks the texts are dealt that meet there, by the share of the sample."""
    none = np.zeros(0, np.int64)
    total = docs.count()
    if not total:
        return none, none, none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingles(x.as_py(), shingle) for x in batch.column(0)], pa.list_(pa.int64()))], names=["s"])

    texts = docs.select(F.col(text_col).cast("binary").alias("text")).where(F.rand(SEED) < SAMPLE / total)
    found = texts.mapInArrow(run, "s array<long>").select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, n = rows.column("h").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
    tasks = np.ceil(n / min(SAMPLE, total) * total / chunk).astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], (rows.num_rows - order).astype(np.int64), tasks[order]


def hashed(docs: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray], *, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, h, node) for every row, and name, n, fp, bits and first shingles for the first row of a node."""
    kind = docs.schema[id_col].dataType.simpleString()
    hashes, rank, tasks = common
    firsts_type = pa.list_(pa.struct([("key", pa.int64()), ("tasks", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        node = TaskContext.get().partitionId() << 33
        for batch in batches:
            nodes, names, sizes, fps, bits, firsts = [], [], [], [], [], []
            for text in batch.column(2):
                tokens = words(text.as_py())
                name = name_of(tokens)
                known = seen.get(name)
                nodes.append(node if known is None else known)
                if known is not None:
                    for column in (names, sizes, fps, bits, firsts):
                        column.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen[name] = node
                node += 1
                every = shingle_hashes(tokens, shingle)
                found = np.sort(np.unique(every).view(np.int64))
                first = first_shingles(found, hashes, rank, similarity)
                deal = np.ones(len(first), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, first), len(hashes) - 1)
                    deal = np.where(hashes[at] == first, np.maximum(1, tasks[at]), 1)
                names.append(name)
                sizes.append(len(found))
                fps.append(majority(every))
                bits.append(parity(found))
                firsts.append([{"key": k, "tasks": t} for k, t in zip(first.tolist(), deal.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(bits, pa.binary()), pa.array(firsts, firsts_type)],
                names=["id", "h", "node", "name", "n", "fp", "bits", "firsts"],
            )

    rows = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h long, node long, name binary, n int, fp long, bits binary, firsts array<struct<key:long,tasks:int>>")


def row_hash(text_col: str):
    """With its id it stands for a row."""
    return F.xxhash64(F.col(text_col).cast("binary"))


# candidates


def _meetings(nodes: DataFrame) -> DataFrame:
    """(key, tasks, part, node, pos, least): nodes at the first shingles at which others are too."""
    met = nodes.select("node", F.posexplode("firsts").alias("pos", "x")).select("x.key", "x.tasks", "node", "pos")
    met = met.withColumn("part", F.when(F.col("tasks") > 1, F.pmod(F.xxhash64("node"), "tasks")).otherwise(F.lit(0)).cast("int"))
    at = Window.partitionBy("key", "part")
    met = met.withColumn("least", F.min("node").over(at)).withColumn("most", F.max("node").over(at))
    return met.where("least < most or tasks > 1").drop("most")


def _stars(met: DataFrame) -> DataFrame:
    """(a, b): each node with the least of its task at a shingle, and these with the shingle's least."""
    spokes = met.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    heads = met.where("tasks > 1").select("key", "least").distinct()
    tops = heads.groupBy("key").agg(F.min("least").alias("a"))
    return spokes.unionByName(heads.join(tops, "key").where("a < least").select("a", F.col("least").alias("b"))).distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal, or were linked at an anchor."""
    by = materialize(nodes.select("node", "fp", F.min("node").over(Window.partitionBy("fp")).alias("first")), "fingerprints")
    equal = by.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    firsts = by.where("first = node")
    x, y = (firsts.select(F.col("fp").alias(k), F.col("node").alias(f"node_{k}")) for k in "ab")
    near = anchor_links(firsts.select(F.col("fp").alias("node")), roots=False).join(x, "a").join(y, "b")
    return equal.unionByName(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def _differ(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Parity bits that differ in pairs of rows, in the smaller width of the two."""
    sizes = np.array([len(x) for x in bits])
    least = np.minimum(sizes[i], sizes[j])
    out = np.zeros(len(i), np.int64)
    for size in np.unique(least).tolist():
        at = np.flatnonzero(least == size)
        rows, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        table = np.array([folded(bits[r], 8 * size) for r in rows.tolist()])
        x, y = place[: len(at)], place[len(at) :]
        step = max(1, (1 << 21) // size)
        for k in range(0, len(at), step):
            out[at[k : k + step]] = np.bitwise_count(table[x[k : k + step]] ^ table[y[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def _meeting(similarity: float, most: int | None):
    """Pairs of the two sides of each group of rows (key, i, j, left, node, label, n, pos, bits) that can be similar
    enough.  Of a group with more than `most` pairs a row, for each label only the pair with the fewest bits apart; the
    group's key, in a row of its own, says that there is more."""

    def possible(g: dict) -> Iterator[np.ndarray]:
        left, right = np.nonzero(g["left"])[0], np.nonzero(~g["left"])[0]
        step = max(1, (1 << 20) // max(1, len(right)))
        for k in range(0, len(left), step):
            x, y = left[k : k + step, None], right[None, :]
            n, m = g["n"][x], g["n"][y]
            need = (n + m) * (similarity / (1 + similarity)) - 1e-6
            ok = (g["label"][x] != g["label"][y]) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)
            # at the first shingle that two sets share, no more is shared than what follows it in both
            ok &= 1 + np.minimum(n - 1 - g["pos"][x], m - 1 - g["pos"][y]) >= need
            p, q = np.nonzero(ok)
            i, j = left[k : k + step][p], right[q]
            differ = _differ(g["bits"], i, j)
            near = differ <= most_apart(g["n"][i] + g["n"][j], similarity)
            yield np.stack([i[near], j[near], differ[near]])

    def best(g: dict, found: np.ndarray) -> np.ndarray:
        label, order = np.concatenate([g["label"][found[0]], g["label"][found[1]]]), np.tile(found[2], 2)
        order = np.lexsort((order, label))
        first = np.flatnonzero(np.diff(label[order], prepend=label[order][0] - 1))
        return found[:, np.unique(order[first] % found.shape[1])]

    def compare(g: dict) -> Iterator[pa.RecordBatch]:
        kept, more = np.zeros((3, 0), np.int64), False
        for found in possible(g):
            kept = np.concatenate([kept, found], axis=1)
            if most is not None and kept.shape[1] > most * len(g["node"]):
                kept, more = best(g, kept), True
            elif most is None and kept.shape[1] > 1 << 16:
                yield pairs(g, kept)
                kept = kept[:, :0]
        if kept.shape[1]:
            yield pairs(g, best(g, kept) if more else kept)
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array(g["key"][:1])], names=["a", "b", "key"])

    def pairs(g: dict, kept: np.ndarray) -> pa.RecordBatch:
        a, b = g["node"][kept[0]], g["node"][kept[1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(table: pa.Table) -> dict:
            out = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "left", "node", "label", "n", "pos")}
            out["bits"] = table.column("bits").to_pylist()
            return out

        def groups(rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = arrays(pa.Table.from_batches(rest))
            cut = np.nonzero((np.diff(g["key"]) != 0) | (np.diff(g["i"]) != 0) | (np.diff(g["j"]) != 0))[0] + 1
            edges = [0, *cut.tolist(), len(g["key"])]
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield from compare({c: v[lo:hi] for c, v in g.items()})

        def last_start(batch: pa.RecordBatch) -> int:
            same = np.ones(batch.num_rows, bool)
            for c in ("key", "i", "j"):
                v = batch.column(batch.schema.get_field_index(c)).to_numpy()
                same &= v == v[-1]
            return 0 if same.all() else int(np.nonzero(~same)[0][-1]) + 1

        rest: list[pa.RecordBatch] = []  # the rows of groups that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            start = last_start(batch)
            same = rest and all(rest[-1].column(rest[-1].schema.get_field_index(c))[-1] == batch.column(batch.schema.get_field_index(c))[0] for c in ("key", "i", "j"))
            if rest and not same:
                yield from groups(rest)
                rest = []
            if start:
                yield from groups([*rest, batch.slice(0, start)])
                rest = []
            rest.append(batch.slice(start))
        if rest:
            yield from groups(rest)

    return run


def _compared(met: DataFrame, labels: DataFrame, facts: DataFrame, similarity: float, chunk: int, most: int | None) -> DataFrame:
    """(a, b, key): pairs of different labels that met and can be similar enough, and keys at which there are more."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([folded(x, meeting_width(n)).tobytes() for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.binary())], names=["node", "n", "bits"])

    rows = met.join(labels, F.col("node") == F.col("k"), "left").select("key", "tasks", "node", "pos", F.coalesce("label", "node").alias("label"))
    spread = [F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")]
    at = Window.partitionBy("key")
    few = rows.where("tasks = 1").withColumns({"low": F.min("label").over(at), "high": F.max("label").over(at), "size": F.count(F.lit(1)).over(at)})
    many = rows.where("tasks > 1")
    many = many.join(many.groupBy("key").agg(*spread), "key")
    rows = few.unionByName(many).where("low < high")
    parts = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    # a pair of chunks is compared once, each with itself as well
    sides = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own <= k).alias("left")))
    sides = F.concat(sides, F.array(F.struct(own.alias("i"), own.alias("j"), F.lit(False).alias("left"))))
    small = facts.select("node", "n", "bits").mapInArrow(fold, "node long, n int, bits binary")
    work = rows.withColumn("sides", sides).select("key", "node", "label", "pos", F.inline("sides")).join(small, "node")
    work = work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return work.select("key", "i", "j", "left", "node", "label", "n", "pos", "bits").mapInArrow(_meeting(similarity, most), "a long, b long, key long").distinct()


# verification


def _narrowed(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, name_a, name_b, apart): pairs of different texts whose sizes and parity bits leave them possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            far = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(6), batch.column(7), strict=True)], np.int64)
            keep = pa.array(far <= most_apart(n, similarity))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*batch.columns[:4], pa.array(far))], names=["a", "b", "name_a", "name_b", "apart"])

    x, y = (facts.select(*[F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in ("node", "name", "n", "bits")]) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").where("name_a <> name_b").where(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - 1e-6)
    return both.select("a", "b", "name_a", "name_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, name_a binary, name_b binary, apart long")


def _sieve(names: DataFrame) -> np.ndarray:
    """Bits of a fixed number that are set for the names, and for few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE, bool)
        for batch in batches:
            bits[[int.from_bytes(x.as_py()[:8], "little") % SIEVE for x in batch.column(0)]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(SIEVE // 8, np.uint8)
    for row in names.mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _sets(docs: DataFrame, names: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(name, s): sets of the named texts and of few others, hashed again from the texts that pass the sieve."""
    wanted = _sieve(names).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8))
        for batch in batches:
            found = []
            for text in batch.column(0):
                tokens = words(text.as_py())
                name = name_of(tokens)
                if bits[int.from_bytes(name[:8], "little") % SIEVE]:
                    found.append((name, np.sort(np.unique(shingle_hashes(tokens, shingle)).view(np.int64)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["name", "s"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "name binary, s binary")


def _similar(similarity: float):
    """Of rows (a, part, b, s), in whose groups the center's own row comes first (b null), the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                other = np.frombuffer(s.as_py(), np.int64)
                if b is None:
                    center, own = a, other
                    continue
                if a != center:
                    raise ValueError(f"the set of {a} is missing")
                at = np.searchsorted(own, other)
                shared = int((own[np.minimum(at, len(own) - 1)] == other).sum()) if len(own) else 0
                if shared / max(1, len(own) + len(other) - shared) >= similarity:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, *, shingle: int, similarity: float, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; a set is moved once for each of its pairs, a center's once a task."""
    # centers of many pairs, at most a SPOKES-th of the pairs: written, so that Spark knows whether they can be sent
    large = pairs.groupBy(F.col("a").alias("center")).agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") > SPOKES)
    large = materialize(large.select("center", F.ceil(F.col("pairs") / F.lit(SPOKES)).cast("int").alias("parts")), "centers")
    dealt = pairs.join(large, F.col("a") == F.col("center"), "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b"), "parts")).otherwise(F.lit(0)).cast("int"))
    dealt = dealt.repartition("a", "part")  # else a center's parts would stay together
    dealt = dealt.withColumn("first", F.row_number().over(Window.partitionBy("a", "part").orderBy("b")) == 1)
    spoke = F.struct(F.col("name_b").alias("name"), "b")
    head = F.struct(F.col("name_a").alias("name"), F.lit(None).cast("long").alias("b"))
    needs = materialize(dealt.select("a", "part", F.inline(F.when(F.col("first"), F.array(spoke, head)).otherwise(F.array(spoke)))), "needs")
    # a text of several rows has its set once
    sets = _sets(docs, needs.select("name"), shingle, text_col).dropDuplicates(["name"])
    rows = needs.join(sets, "name").select("a", "part", "b", "s").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = materialize(rows.mapInArrow(_similar(similarity), "a long, b long"), "links")
    release(needs)
    release(large)
    return found


# groups


def labelled(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, h, label) of every row; rows of one label are joined by near copies."""
    common = common_shingles(docs, shingle, text_col, chunk)
    rows = materialize(hashed(docs, common, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col), "shingles")
    nodes = rows.where("n is not null")
    facts = nodes.select("node", "name", "n", "bits")
    # the same text in several tasks
    twins = nodes.select("node", F.min("node").over(Window.partitionBy("name")).alias("own")).where("node > own")
    known = materialize(twins.select(F.col("own").alias("a"), F.col("node").alias("b")), "twins")

    def check(pairs: DataFrame) -> DataFrame:
        return verified(docs, pairs, shingle=shingle, similarity=similarity, text_col=text_col)

    def names() -> DataFrame:
        return components(known).select(F.col("node").alias("k"), "label")

    met = materialize(_meetings(nodes), "meetings")
    near = _narrowed(_stars(met).unionByName(_by_fingerprint(nodes)).distinct(), facts, similarity)
    near = near.groupBy("b").agg(F.min(F.struct("apart", "a", "name_a", "name_b")).alias("x")).select("x.a", "b", "x.name_a", "x.name_b")
    tried = materialize(near, "pairs")
    known = known.unionByName(check(tried))
    labels = names()
    open_ = met
    for most in (*[MOST_PAIRS] * ROUNDS, None):
        rest = materialize(_compared(open_, labels, facts, similarity, chunk, most), "met")
        pairs = rest.where("a is not null").select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(_narrowed(pairs, facts, similarity), "pairs")
        if not pairs.isEmpty():
            tried = tried.select("a", "b").unionByName(pairs.select("a", "b"))
            known = known.unionByName(check(pairs))
            labels = names()
        more = rest.where("a is null").select("key").distinct()
        if more.isEmpty():
            break
        open_ = met.join(more, "key", "left_semi")
    release(met)
    return rows.select("id", "h", "node").join(labels, F.col("node") == F.col("k"), "left").select("id", "h", F.coalesce("label", "node").alias("label"))


def groups(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, component_id) for every document; the component is named by its smallest id."""
    rows = materialize(labelled(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col, chunk=chunk), "labelled")
    least = rows.groupBy("label").agg(F.min("id").alias("component_id"))
    return rows.join(least, "label").select(F.col("id").alias(id_col), "component_id")
