"""SimHash near-duplicates found by anchor-point covering.

A fingerprint's bit is the majority of that bit in the hashes of the text's word shingles.  To find
all pairs within `distance` bits exactly, the 64 bits are split into two halves: of any pair within
3 bits, one half differs in at most 1.  The anchors of a half are the code words of the [31, 26]
Hamming code over its low 31 bits.  The code is perfect, so each half has exactly one anchor within
its covering radius of 1: its home.  A half that differs in one bit lies within radius plus
threshold, 2, of that anchor.  So each fingerprint is sent home and to every anchor within 2 (at
most 16), and only homes are compared with visitors at an anchor.  An anchor sees a 2^26th of a
half's values and their neighbours, however many texts there are.

Looser copies, of a given similarity of their shingles, are built on these links in `copies`.

Equal fingerprints are one node.  An anchor with many fingerprints is cut into chunks, and pairs of
chunks are compared by separate tasks, each of which returns one edge a node it could link, never all
pairs.  Components come from min-label propagation with pointer jumping, a join
and an aggregation a round; their rounds are written to the shared checkpoint folder.

Defined results: null and empty texts, and those of white space, have fingerprint 0 and are linked
like any other; a text of fewer words than a shingle is one shingle; repeated rows are one group; a
null doc_id is in a group but never its id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, materialize

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of an anchor that one task compares with as many others.
CHUNK = 4096
#: Shingle hashes whose bits are counted at a time.
SLICE = 1 << 16
MAX_ROUNDS = 60


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The majority bits of the XXH64 of the text's shingles, as a signed long."""
    import xxhash

    tokens = (text or b"").translate(LOWER_AZ).split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens)] if len(tokens) < shingle else map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
    return majority(np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), ">u8"))


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _syndrome(half: Column) -> Column:
    """Of the low 31 bits, bit k standing for place k + 1: the place whose flip gives a code word, 0 if it is one."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << k for k in range(31) if (k + 1) >> j & 1)
        out = out + (F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * F.lit(1 << j))
    return out


def anchors(nodes: DataFrame) -> DataFrame:
    """(anchor, home, node): each fingerprint at the home and at every anchor within 2 of either half."""
    low = F.lit((1 << 31) - 1).cast("long")
    halves = F.array(*[F.struct(F.lit(h).cast("long").alias("half"), F.shiftrightunsigned(F.col("node"), 32 * h).bitwiseAND(low).alias("bits")) for h in range(2)])
    rows = nodes.select("node", F.inline(halves)).withColumn("s", _syndrome(F.col("bits")))
    home = F.expr("if(s > 0, bits ^ shiftleft(1L, s - 1), bits)")
    # two flips reach a code word if their places add up (xor) to the syndrome
    visits = F.expr("transform(filter(sequence(1, 31), p -> s > 0 and p < (p ^ s)), p -> bits ^ shiftleft(1L, p - 1) ^ shiftleft(1L, (p ^ s) - 1))")
    at = F.concat(F.array(F.struct(home.alias("anchor"), F.lit(True).alias("home"))), F.transform(visits, lambda a: F.struct(a.alias("anchor"), F.lit(False).alias("home"))))
    # the half's number stands above the anchor's 31 bits
    return rows.select("node", "half", F.inline(at)).select((F.col("anchor") + F.shiftleft(F.col("half"), 40)).alias("anchor"), "home", "node")


def _forest(homes: np.ndarray, others: np.ndarray, distance: int, roots: bool) -> list[tuple[int, int]]:
    """What links between homes and others join: each node with the least node it is joined with, so that anchors
    which share that node say the same, or the links of a spanning forest.  A block of homes is in memory at a time."""
    nodes = np.unique(np.concatenate([homes, others]))
    parent = list(range(len(nodes)))
    made = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    place_h, place_o = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    step = max(1, (1 << 20) // max(1, len(others)))
    for k in range(0, len(homes), step):
        apart = np.bitwise_count(homes[k : k + step, None].view(np.uint64) ^ others[None, :].view(np.uint64))
        for i, j in zip(*np.nonzero(apart <= distance), strict=True):
            a, b = int(place_h[k + i]), int(place_o[j])
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                made.append((int(nodes[max(a, b)]), int(nodes[min(a, b)])))
    return [(int(nodes[k]), int(nodes[r])) for k in range(len(nodes)) if (r := root(k)) != k] if roots else made


def links(nodes: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK, roots: bool = True) -> DataFrame:
    """(a, b): edges that join all fingerprints (node) within `distance` bits of each other.

    With roots each node is joined with the least one that its anchors reach; else the edges are linked pairs themselves."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves of radius 1 cover distances up to 3")
    at = Window.partitionBy("anchor")
    rows = anchors(nodes)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(at)).withColumn("homes", F.sum(F.col("home").cast("int")).over(at)).where("n > 1 and homes > 0")
    # homes at their anchor are compared with all that are there, in chunks by the node
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("left")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    pairs = F.concat(pairs, F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("left"))))
    work = rows.withColumn("pairs", pairs).select("anchor", "node", F.inline("pairs"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        node, left = group.column("node").to_numpy(), group.column("left").to_numpy()
        edges = _forest(node[left], node[~left], distance, roots)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    edges = work.groupBy("anchor", "i", "j").applyInArrow(compare, "a long, b long")
    return contracted(edges) if roots else edges.distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with b < a that join the same nodes: of each node all its partners go to the least of them.

    A node has a partner for each chunk of its anchors at most (17 anchors a half), so the sets are small; what
    anchors say alike becomes one edge."""
    own = edges.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("bs"))
    least = F.col("bs")[0]
    others = F.transform(F.slice("bs", F.lit(2), F.size("bs")), lambda b: F.struct(b.alias("a"), least.alias("b")))
    return own.select(F.inline(F.concat(F.array(F.struct(F.col("a"), least.alias("b"))), others))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of (a, b).

    Every round a node takes the least label of itself, its neighbours and its label's label."""
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        lower = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("label").alias("far"))
        new = materialize(lower.join(jump, "l", "left").select("node", F.coalesce(F.least("far", "l"), "l").alias("label"), F.col("label").alias("was")), "labels")
        done = new.where("label <> was").isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every document; the component is named by its smallest id."""
    rows = materialize(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    return group_by_fingerprint(rows, distance=distance, id_col=id_col)


def group_by_fingerprint(rows: DataFrame, *, distance: int = DISTANCE, id_col: str = "doc_id") -> DataFrame:
    """Components of a table of fingerprints (id, fp); equal fingerprints are one node."""
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    labels = components(links(nodes.select(F.col("fp").alias("node")), distance)).select(F.col("node").alias("k"), "label")
    named = nodes.join(labels, F.col("fp") == F.col("k"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = named.join(least, "label").select("fp", "component_id")
    return rows.join(by_node, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: one with the smallest id.

    Near copies have a Jaccard similarity of their shingles of `similarity` or more; all such pairs are found (see copies).
    A row is told by its id and text: rows that share an id but are in different groups all count by themselves, and
    of rows that share both one stays, the least by its columns as JSON.  Rows without an id all stay.  Null and empty
    texts are one group; an empty table gives none."""
    from .copies import labelled, row_hash

    found = labelled(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col).where("id is not null")
    found = materialize(found.groupBy("id", "h", "label").agg(F.count(F.lit(1)).alias("n")), "near-copies")
    kept = found.groupBy("label").agg(F.min(F.struct("id", "h")).alias("k")).select("k.id", "k.h")
    kept = materialize(kept.join(found.select("id", "h", "n"), ["id", "h"]).select(F.col("id").alias("kept_id"), F.col("h").alias("kept_h"), "n"), "kept")
    # the documents' columns are one, so that they may have any names
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"), F.col(id_col).alias("id"), row_hash(text_col).alias("h"))
    rows = rows.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left")
    single = rows.where("id is null or n = 1").select("r")
    several = rows.where("n > 1").groupBy("id", "h").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r")
    return single.unionByName(several).select("r.*")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
