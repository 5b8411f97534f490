"""Graphs as edge tables: components, shortest distances and closures over a semiring.

Each round is a join of a frontier with the edges and an aggregation with the semiring's addition; rounds are
written out, so plans stay short and lost executors cost a round at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


@dataclass(frozen=True)
class Semiring:
    """Addition as an aggregate and as a binary function, multiplication as a function, and the units."""

    name: str
    add: Callable[[Column], Column]
    plus: Callable[[Column, Column], Column]
    times: Callable[[Column, Column], Column]
    zero: object
    one: object
    idempotent: bool = True


BOOLEAN = Semiring("boolean", F.bool_or, lambda a, b: a | b, lambda a, b: a & b, False, True)
TROPICAL = Semiring("tropical", F.min, lambda a, b: F.least(a, b), lambda a, b: a + b, float("inf"), 0.0)
VITERBI = Semiring("viterbi", F.max, lambda a, b: F.greatest(a, b), lambda a, b: a * b, 0.0, 1.0)
COUNTING = Semiring("counting", F.sum, lambda a, b: a + b, lambda a, b: a * b, 0, 1, idempotent=False)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node reachable, for the nodes of edges (a, b) of any direction."""
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("m"))
        lower = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("l"))
        jumps = labels.select(F.col("node").alias("l"), F.col("label").alias("far"))
        new = materialize(lower.join(jumps, "l", "left").select("node", F.coalesce(F.least("far", "l"), "l").alias("label"), F.col("label").alias("was")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def distances(edges: DataFrame, source: object, ring: Semiring = TROPICAL, rounds: int = 100) -> DataFrame:
    """(node, value): the sum over paths from the source of the products of their weights, for edges (src, dst, weight).

    For idempotent semirings only what improved goes on to the next round.  Counting needs a graph without
    cycles: it carries each round's new paths on and adds them up."""
    spark = edges.sparkSession
    kind = edges.schema["weight"].dataType.simpleString()
    known = materialize(spark.range(1).select(F.lit(source).cast(edges.schema["src"].dataType).alias("node"), F.lit(ring.one).cast(kind).alias("value")), "distances")
    frontier = known
    for _ in range(rounds):
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy("dst").agg(ring.add(ring.times(F.col("value"), F.col("weight"))).cast(kind).alias("new"))
        step = materialize(step, "distances")
        if step.isEmpty():
            return known
        joined = known.join(step, known["node"] == step["dst"], "full").select(F.coalesce("node", "dst").alias("node"), F.col("value").alias("was"), F.col("new"))
        merged = F.when(F.col("was").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("was")).otherwise(ring.plus(F.col("was"), F.col("new")))
        table = materialize(joined.select("node", "was", "new", merged.cast(kind).alias("value")), "distances")
        known = table.select("node", "value")
        if ring.idempotent:
            frontier = table.where(F.col("was").isNull() | (F.col("was") != F.col("value"))).select("node", "value")
        else:
            frontier = step.select(F.col("dst").alias("node"), F.col("new").alias("value"))
        if frontier.isEmpty():
            return known
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def closure(edges: DataFrame, ring: Semiring = BOOLEAN, rounds: int = 30) -> DataFrame:
    """(src, dst, weight) for all pairs, without the empty paths, by squaring; idempotent semirings only."""
    if not ring.idempotent:
        raise ValueError("closure by squaring needs an idempotent addition")
    kind = edges.schema["weight"].dataType.simpleString()
    paths = materialize(edges.groupBy("src", "dst").agg(ring.add(F.col("weight")).cast(kind).alias("weight")), "paths")
    for _ in range(rounds):
        left, right = paths.alias("x"), paths.alias("y")
        longer = left.join(right, F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"), ring.times(F.col("x.weight"), F.col("y.weight")).cast(kind).alias("weight"))
        new = materialize(paths.unionByName(longer).groupBy("src", "dst").agg(ring.add(F.col("weight")).cast(kind).alias("weight")), "paths")
        if new.exceptAll(paths).isEmpty():
            return new
        paths = new
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def fold(nodes: DataFrame, edges: DataFrame, gather: Callable[[Column], Column], combine: Callable[[Column, Column], Column], rounds: int = 200) -> DataFrame:
    """(node, value) folded over a graph without cycles: a node's own value (nodes: node, value) combined with what its
    children's values (edges: parent, child) gather to, null for a leaf.  A round settles the nodes all of whose children are."""
    kind = nodes.schema["value"].dataType.simpleString()
    links = materialize(edges.select("parent", "child").distinct().join(nodes.select(F.col("node").alias("child")), "child", "left_semi"), "links")
    open_, done = materialize(nodes.select("node", "value"), "open"), None
    for _ in range(rounds):
        waiting = links.join(open_.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
        ready = open_.join(waiting, "node", "left_anti")
        if done is not None:
            heard = links.join(done.select(F.col("node").alias("child"), F.col("value").alias("v")), "child").groupBy(F.col("parent").alias("node")).agg(gather(F.col("v")).alias("below"))
            ready = ready.join(heard, "node", "left")
        else:
            ready = ready.withColumn("below", F.lit(None).cast(kind))
        settled = materialize(ready.select("node", combine(F.col("value"), F.col("below")).cast(kind).alias("value")), "settled")
        if settled.isEmpty():
            raise ValueError("the graph has a cycle")
        done = settled if done is None else materialize(done.unionByName(settled), "done")
        open_ = materialize(open_.join(settled.select("node"), "node", "left_anti"), "open")
        if open_.isEmpty():
            return done
    raise RuntimeError(f"nodes are open after {rounds} rounds")


def refine(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, block): the coarsest partition that respects labels (nodes: node, label) and moves (edges: src, kind, dst),
    so that nodes of a block lead by the same kinds to the same blocks; a block is named by its least node.

    A node's moves are compared by their number and the sum of their hashes, which combines before rows move."""
    blocks = nodes.groupBy("label").agg(F.min("node").alias("block"))
    state = materialize(nodes.join(blocks, nodes["label"].eqNullSafe(blocks["label"])).select("node", "block"), "blocks")
    count = state.select("block").distinct().count()
    for _ in range(rounds):
        moves = edges.join(state.select(F.col("node").alias("dst"), F.col("block").alias("to")), "dst").select(F.col("src").alias("node"), "kind", "to").distinct()
        marks = moves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("kind", "to").cast("decimal(38,0)")).alias("h"))
        signed = state.join(marks, "node", "left").fillna({"n": 0}).withColumn("h", F.coalesce("h", F.lit(0)))
        least = signed.groupBy("block", "n", "h").agg(F.min("node").alias("new"))
        state = materialize(signed.join(least, ["block", "n", "h"]).select("node", F.col("new").alias("block")), "blocks")
        now = state.select("block").distinct().count()
        if now == count:
            return state
        count = now
    raise RuntimeError(f"blocks still split after {rounds} rounds")
