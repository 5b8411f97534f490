"""Balanced label propagation: documents move towards the shards of documents they are linked with.

Links join documents of equal text.  The law is `rows`: the shards' row counts are at most one apart.

A group's documents in one shard are alike to the propagation, so the state has one row for each
group and shard (a cell) with the number of its documents: a group that holds a third of all rows is
at most as many cells as there are shards.  Documents of linked groups start dealt out evenly.  In
each round a group wants its cells together in the shards where most of it already is - one, or as
many as it takes to hold it - and quotas limit the moves from shard to shard: as many documents as
move the other way, and beyond that the room that documents without links leave.  Moves are taken
from the largest gain on.  Quotas keep every shard within its size at all times, so the counts stay
exact.  Documents without links fill what is left.  Only SQL functions are used.

Defined results: null texts are equal to each other; size is 16 plus the text's UTF-8 bytes; repeated
rows are separate rows of a group; an empty table has no shards; a null doc_id is a row like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rank, materialize, release

SHARDS = 40
ROUNDS = 8
#: A round that moves less than this share of the linked documents is the last.
LEAST_MOVES = 0.0005
#: Groups of more documents than this are ranked in parts.
LARGE_GROUP = 1024


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group key g): what the propagation needs of a document."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long") + 16
    return docs.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(raw)).alias("g"))


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _by_shard(values: list[int]):
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def initial_cells(groups: DataFrame, shards: int) -> DataFrame:
    """Cells (g, size, shard, n) of the linked groups dealt out in turn, one group behind the other."""
    spread = F.crc32(F.col("g").cast("binary"))
    part = F.pmod(spread, F.lit(256)).cast("int")
    rows = groups.withColumn("part", part)
    sums = rows.groupBy("part").agg(F.sum("size").alias("s"))
    starts = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # 256 rows
    before = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("before", before).join(F.broadcast(starts), "part").withColumn("o", F.col("base") + F.col("before"))
    r = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(shards).cast("long")) - 1)).alias("r")
    return placed.select("g", "size", "o", r).select(
        "g", "size", F.pmod(F.col("o") + F.col("r"), F.lit(shards)).cast("int").alias("shard"), F.expr(f"(size - 1 - r) div {shards} + 1").alias("n")
    )


def propagate(cells: DataFrame, total: int, shards: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[dict[str, int]]]:
    """Rounds of label propagation; also returns each round's moved documents and cut links before it."""
    quotas = _quotas(total, shards)
    capacity = max(quotas)
    state, history = cells, []
    for _ in range(rounds):
        in_group = Window.partitionBy("g").orderBy(F.desc("n"), F.xxhash64("g", "shard"), "shard")
        wide = F.ceil(F.col("size") / F.lit(capacity)).cast("int")
        ranked = state.withColumn("rank", F.row_number().over(in_group)).withColumn("wide", wide)
        homes = F.sort_array(F.collect_list(F.when(F.col("rank") <= F.col("wide"), F.struct("rank", "shard"))).over(Window.partitionBy("g")))
        ranked = ranked.withColumn("homes", homes)  # at most one entry a shard
        target = F.element_at("homes", (F.pmod(F.col("rank"), F.size("homes")) + 1).cast("int"))["shard"]
        best = F.max("n").over(Window.partitionBy("g"))
        wanted = ranked.select("g", "size", "shard", "n", F.when(F.col("rank") > F.col("wide"), target).alias("to"), (best / F.col("size")).alias("gain"))
        wanted = materialize(wanted, "shard-wishes")
        # documents of linked groups in each shard, and the demand between shards: shards squared rows at most
        demand = {(r["shard"], r["to"]): r["n"] for r in wanted.where("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        held = {r["shard"]: r["n"] for r in wanted.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        quota: dict[tuple[int, int], int] = {}
        for j in range(shards):
            room = quotas[j] - held.get(j, 0)
            for i in range(shards):
                want, back = demand.get((i, j), 0), demand.get((j, i), 0)
                extra = max(0, min(want - min(want, back), room))
                room -= extra
                if min(want, back) + extra:
                    quota[i, j] = min(want, back) + extra
        moved = sum(quota.values())
        history.append({"moved": moved, "wanted": sum(demand.values())})
        if not moved or moved < LEAST_MOVES * sum(held.values()):
            release(wanted)
            break
        limits = F.create_map(*[x for (i, j), q in quota.items() for x in (F.lit(i * shards + j), F.lit(int(q)).cast("long"))])
        limit = F.coalesce(F.element_at(limits, F.col("shard") * shards + F.col("to")), F.lit(0).cast("long"))
        lane = Window.partitionBy("shard", "to").orderBy(F.desc("gain"), "size", "g").rowsBetween(Window.unboundedPreceding, -1)
        movers = wanted.where("to is not null")
        # a demand that its quota covers whole needs no order; the others are taken in order of gain
        covered = F.create_map(*[x for (i, j), n in demand.items() for x in (F.lit(i * shards + j), F.lit(quota.get((i, j), 0) >= n))])
        movers = movers.withColumn("whole", F.element_at(covered, F.col("shard") * shards + F.col("to")))
        partly = movers.where("not whole").withColumn("go", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), limit - F.coalesce(F.sum("n").over(lane), F.lit(0)))))
        moves = movers.where("whole").withColumn("go", F.col("n")).unionByName(partly)
        flows = moves.select("g", "size", F.inline(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n")))))
        new = wanted.where("to is null").select("g", "size", "shard", "n").unionByName(flows.where("n > 0"))
        state = materialize(new.groupBy("g", "size", "shard").agg(F.sum("n").alias("n")), "shard-cells")
        release(wanted)
    return state, history


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size) for every document."""
    rows = materialize(keyed(docs), "shard-rows")
    return _assign(rows, shards, rounds)


def _assign(rows: DataFrame, shards: int, rounds: int) -> DataFrame:
    groups = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shard-groups")
    total = rows.count()
    cells, _ = propagate(materialize(initial_cells(groups, shards), "shard-cells"), total, shards, rounds)
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    quotas = _quotas(total, shards)
    # a group's cells as the upper ends of its documents' ranks, at most one entry a shard
    ends = F.sum("n").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    plan = cells.withColumn("end", ends).groupBy("g").agg(F.first("size").alias("group_size"), F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    # written, so that its size is known before the documents are dealt out by group for a join
    plan = materialize(plan, "shard-plan")
    joined = rows.withColumnRenamed("size", "bytes").join(plan, "g", "left")
    linked = joined.where("ends is not null")
    # ranks inside a group: large groups are dealt into parts of about LARGE_GROUP documents
    parts = F.ceil(F.col("group_size") / F.lit(LARGE_GROUP)).cast("int")
    linked = linked.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    order = [F.col("doc_id"), F.col("bytes")]
    linked = linked.repartition("g", "part")  # else a large group's parts would stay together
    linked = linked.withColumn("rn", F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1)
    sizes = linked.where("group_size > " + str(LARGE_GROUP)).groupBy("g", "part").agg(F.count(F.lit(1)).alias("k"))
    starts = sizes.select(F.col("g").alias("g2"), F.col("part").alias("p2"), F.coalesce(F.sum("k").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    small, large = linked.where(f"group_size <= {LARGE_GROUP}").withColumn("rank", F.col("rn").cast("long")), linked.where(f"group_size > {LARGE_GROUP}")
    large = large.join(starts, (F.col("g") == F.col("g2")) & (F.col("part") == F.col("p2"))).withColumn("rank", F.col("base") + F.col("rn"))
    columns = ["doc_id", "bytes", "text_crc32", "group_size", "rank", "ends"]
    placed = small.select(*columns).unionByName(large.select(*columns))
    placed = placed.withColumn("shard", F.expr("filter(ends, e -> e.end > rank)[0].shard")).select("doc_id", "bytes", "text_crc32", "group_size", "shard")
    # documents without links fill the shards up
    free = joined.where("ends is null").select("doc_id", "bytes", "text_crc32", F.lit(1).cast("long").alias("group_size"))
    free = bounded_rank(free.withColumn("one", F.lit(1)), ["one"], F.xxhash64("doc_id"), [F.col("doc_id"), F.col("bytes"), F.col("text_crc32")], "rank", 512)
    fill, end = [], 0
    for s in range(shards):
        end += quotas[s] - held.get(s, 0)
        fill.append((end, s))
    ladder = F.array(*[F.struct(F.lit(e).cast("long").alias("end"), F.lit(s).alias("shard")) for e, s in fill])
    free = free.withColumn("ladder", ladder).withColumn("shard", F.expr("filter(ladder, e -> e.end > rank)[0].shard")).select("doc_id", "bytes", "text_crc32", "group_size", "shard")
    placed = placed.unionByName(free)
    out = bounded_rank(placed, ["shard"], F.xxhash64("doc_id", "text_crc32"), [F.col("doc_id"), F.col("bytes"), F.col("text_crc32")], "slot", 64)
    return out.select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_size"
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The documents with all their columns, and their shard and slot, which replace columns of these names.

    The assignments of rows with equal id and text are interchangeable: such rows take them in turn."""
    spots = shard(docs, shards, rounds)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # rows of one id and text: a few, unless the input repeats them
    dealt = spots.groupBy(key.alias("__key"), F.col("text_crc32").alias("__crc")).agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("__spots"))
    rows = docs.withColumn("__id", key).withColumn("__c", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("__id", "__c").orderBy("__c")))
    out = rows.join(dealt, (F.col("__id") == F.col("__key")) & (F.col("__c") == F.col("__crc")))
    spot = F.col("__spots")[F.col("__copy") - 1]
    return out.select(*[docs[c] for c in docs.columns if c not in ("shard", "slot")], spot["shard"].alias("shard"), spot["slot"].alias("slot"))
