"""Mixing sources to target weights by capped water-filling, with SQL functions only.

Sources, ordered by code point with null last, take the weights in turn and share a budget in
proportion to them.  A source that would be read more than `max_epochs` times is clamped there and
its excess is shared again among the others by weight, until no source is above its clamp.

A source's target is met by whole repetitions of all its documents and one fractional repetition:
its documents stand in an order given by a seeded hash, and those whose words lie within the
fraction are taken once more.  The document on the border is taken with just the words that are
missing, so that a source misses its target by less than one word.  The order is cut into buckets
by the hash's first byte, so a source that holds a third of all rows is ranked in many tasks.

Defined results: a null text has size 0, a null source is a source of its own, sources of size 0
have target 0, an empty table gives no rows; equal rows are separate rows.  A null doc_id is hashed
as an empty string.  Columns of the input other than those named are kept by `mix` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import global_rank
from .common import SPACE_CLASS, WORD_CLASS, materialize

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size).  One row a source from the first aggregation on."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = global_rank(per, [F.col("source").asc_nulls_last()], "rank", "mix-ranks")  # in ranges: there may be a source a host
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    state = materialize(per.select("source", "source_size", weight.alias("weight")), "mix-sources")
    spark = sizes.sparkSession
    total = state.agg(F.sum("source_size")).first()[0] or 0
    budget = F.lit(float(int(total) * budget_percent)) / F.lit(100.0)
    exact = lambda value: F.lit(str(value)).cast("decimal(27,0)")  # noqa: E731  products of sizes and weights are beyond longs
    cap = F.col("source_size") * F.lit(max_epochs)
    clamped = F.lit(False)
    free_weight, clamped_sum, before = 0, 0, -1
    while True:
        n, free_weight, clamped_sum = state.select(
            F.sum(clamped.cast("long")), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))), F.sum(F.when(clamped, cap).otherwise(0))
        ).first()
        n, free_weight, clamped_sum = n or 0, free_weight or 0, clamped_sum or 0
        if n == before or not free_weight:
            break
        before = n
        # clamps only ever grow in number: the level never falls
        level = exact(int(total) * budget_percent - 100 * int(clamped_sum)) * F.col("weight").cast("decimal(10,0)")
        clamped = cap.cast("decimal(27,0)") * F.lit(str(100 * int(free_weight))).cast("decimal(10,0)") < level
    share = F.col("weight") * (budget - F.lit(float(clamped_sum))) / F.lit(float(free_weight or 1))
    target = F.when(clamped if free_weight else F.lit(True), cap.cast("double")).otherwise(share)
    return state.select("source", "source_size", target.cast("double").alias("target"))


def plan_mix(docs: DataFrame, *, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, part, taken): a document is taken `whole` times and `part` words."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("h"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("c")), "mix-sizes"
    )
    targets = source_targets(sizes, weights, budget_percent, max_epochs)
    bucket = F.substring("h", 1, 2)
    rows = sizes.withColumn("b", bucket)
    counts = rows.groupBy("source", "b").agg(F.sum("size").alias("n"))
    # 256 buckets a source
    start = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = (
        counts.select("source", "b", start.alias("start")).alias("x").join(targets.alias("t"), F.col("x.source").eqNullSafe(F.col("t.source")))
        .select(F.col("x.source").alias("s"), F.col("x.b").alias("sb"), "start", "source_size", "target")
    )
    inner = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size", "c").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = placed.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb")))
    goal = F.round(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = goal - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start") - F.col("before")))
    return joined.select("doc_id", "source", "size", "h", "c", "source_size", "target", whole.alias("whole"), part.alias("part"), (whole * F.col("size") + part).alias("taken"))


def first_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word, white space kept.

    Words and the spaces before them alternate in the pieces, so k words are at most the first 2k pieces."""
    pieces = F.regexp_extract_all(text, F.lit(f"({SPACE_CLASS}*{WORD_CLASS}+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), k.cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every document repeated as planned, the border documents also by their first words.

    Keeps the columns of docs.  As a source's fraction ends at one place of its order, a row a source says what is
    taken, and texts are not moved.  Equal rows on the border share its words evenly."""
    plan = plan_mix(docs, **options)
    key = F.struct("h", "doc_id", "size", "c")
    taken = plan.where("part > 0 or whole > 0").groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("part") > 0, key)).alias("border"))
    taken = materialize(taken.select(F.col("source").alias("s"), "whole", "border"), "mix-borders")
    on = F.col("source").eqNullSafe(F.col("s"))
    at_border = plan.join(taken, on).where(key == F.col("border")).groupBy("source").agg(F.sum("part").alias("p"), F.count(F.lit(1)).alias("m"))
    borders = materialize(taken.join(at_border.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "whole", "border", F.expr("p div m").alias("share")), "mix-borders")
    seed = options.get("seed", SEED)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    own = F.struct(order.alias("h"), F.col("doc_id"), word_count(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("c"))
    named = {c: f"__{c}" for c in ("s", "whole", "border", "share")}
    rows = docs.withColumn("__own", own).join(borders.withColumnsRenamed(named), F.col("source").eqNullSafe(F.col("__s")))
    # -1 stands for the whole text
    extra = F.when(F.col("__own") < F.col("__border"), F.lit(-1)).when((F.col("__own") == F.col("__border")) & (F.col("__share") >= F.col("__own.size")), F.lit(-1)).when(F.col("__own") == F.col("__border"), F.col("__share").cast("int"))
    takes = F.filter(F.concat(F.array_repeat(F.lit(-1), F.col("__whole").cast("int")), F.array(extra)), lambda k: k.isNotNull() & (k != 0))
    out = rows.withColumn("__take", F.explode(takes))
    cut = F.col("__take") >= 0
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.when(cut, first_words(F.col("text"), F.col("__take"))).otherwise(F.col("text")).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(cut, F.length(first_words(F.col("text"), F.col("__take")))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def oracle_sql(docs: str = "documents") -> str:
    """DuckDB SQL of the plan's digest, by the closed form of the water level."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS sz FROM d GROUP BY source),
w AS (SELECT source, sz, CAST([{weights}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS BIGINT) AS wt FROM s),
b AS (SELECT CAST(sum(sz) AS BIGINT) AS total FROM w),
l AS (
  SELECT a.source, a.sz, a.wt,
         {BUDGET_PERCENT} * (SELECT total FROM b)::HUGEINT * a.wt >
         100 * (a.wt::HUGEINT * sum(CASE WHEN o.sz * a.wt <= a.sz * o.wt THEN {MAX_EPOCHS} * o.sz ELSE 0 END)
                + {MAX_EPOCHS} * a.sz::HUGEINT * sum(CASE WHEN o.sz * a.wt <= a.sz * o.wt THEN 0 ELSE o.wt END)) AS clamped
  FROM w a, w o GROUP BY a.source, a.sz, a.wt),
f AS (SELECT CAST(coalesce(sum(CASE WHEN clamped THEN {MAX_EPOCHS} * sz END), 0) AS DOUBLE) AS cs, CAST(coalesce(sum(CASE WHEN NOT clamped THEN wt END), 1) AS DOUBLE) AS fw FROM l),
t AS (
  SELECT source, sz, CASE WHEN clamped THEN CAST({MAX_EPOCHS} * sz AS DOUBLE)
         ELSE wt * (CAST({BUDGET_PERCENT} * (SELECT total FROM b) AS DOUBLE) / 100.0 - cs) / fw END AS target FROM l, f),
p AS (
  SELECT d.doc_id, d.size, t.sz AS source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, goal - whole * source_size - before)) AS BIGINT) AS taken
FROM q"""
