"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Every source has a target number of words and a weight schedule over training time 0..1. Its
schedule's integral is its cumulative demand. A source supplies its documents in a fixed hashed
order, again and again; the word at cumulative supply c is due at the time when the demand reaches
c, which the integral's inverse gives in closed form. Documents sorted by that position, across
ranges, are the curriculum.

Prefix sums within a source are taken in two levels: over parts of the hashed order that hold about
PART_ROWS rows each, then within a part, so that no task sees a whole source.

Defined results: a null text has size 0; null is a source of its own, last; a null doc_id is a
document like others; repeated rows are documents of their own; a source without words has target 0.
Extra columns are ignored by `assign` and kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, prepare

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
PART_ROWS = 4096
#: Knots (time, weight) of the piecewise linear schedules, dealt to the sources in their order:
#: early, even and late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def demand_time(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches a fraction of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    whole, before, found = sum(areas), 0.0, F.lit(float(knots[0][0]))
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        if area:
            slope, rest = (w1 - w0) / (t1 - t0), fraction * whole - before
            own = rest / w0 if not slope else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + rest * (2 * slope))) - w0) / slope
            found = F.when(fraction * whole >= before, F.least(F.lit(float(t1)), t0 + own)).otherwise(found)
        before += area
    return found


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """Adds rank, weight and target to rows (source, source_size).

    Filling up by weight, with the excess over a cap of `most` times the size shared again, ends at
    the level where the sum of min(cap, level * weight) is the whole; the sources capped there are a
    prefix in the order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = F.sum("source_size").over(everything) * share
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (whole - capped) / left)
    # The first source, in that order, whose cap is above the level that its predecessors leave.
    open_at = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    level = level.withColumn("fill", open_at["level"])
    return level.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap")))).select("source", "source_size", "rows", "rank", "target")


def assign(docs: DataFrame, schedules: Sequence = SCHEDULES, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, row_key, positions: a row for each document, in the
    order of its first position.

    taken: words that the mix takes; the last document of a source is cut where the target ends.
    positions: for each time the document comes up, the training time 0..1 of its first word.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("mixed"),
        F.xxhash64("doc_id", "source", "text").alias("row_key"),
    )
    rows = durable(rows)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    sources = sources.withColumnRenamed("source", "of")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    hashed = F.conv(F.substring("mixed", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("part", F.floor(hashed * F.ceil(F.col("rows") / PART_ROWS)).cast("int"))
    parts = rows.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("rank", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "part").orderBy("mixed", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["rank", "part"])
    rows = rows.withColumn("start", F.col("start") + F.col("base"))
    whole = F.floor("target")
    turns = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - F.col("start") - F.col("source_size") * k)) for k in range(MOST_REPEATS)]
    times = []
    for k, words in enumerate(turns):
        due = F.try_divide(F.col("start") + F.col("source_size") * k, F.col("target"))
        time = F.element_at(F.array(*(demand_time(due, s) for s in schedules)), (F.pmod("rank", F.lit(len(schedules))) + 1).cast("int"))
        times.append(F.when(words > 0, time))
    rows = rows.withColumn("taken", sum(turns[1:], turns[0])).withColumn("positions", F.array_compact(F.array(*times)))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", "row_key", "positions")
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return rows.repartitionByRange(partitions(docs.sparkSession), first, "row_key").sortWithinPartitions(first, "row_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, once for each time they come up,
    range-sorted by training position."""
    # Neither key is null, so that the join finds the texts where the aggregate has left them.
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plan = assign(docs, **options).filter("taken > 0").select(F.col("row_key").alias("__key"), known.alias("__id"), F.explode("positions").alias("__at"))
    # A text per key, so that rows that repeat come up as often as the plan has them.
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "source", "text")).withColumn("__id", known)
    one = keyed.groupBy("__key", "__id").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    out = one.join(plan, ["__key", "__id"])
    return out.repartitionByRange(partitions(docs.sparkSession), "__at", "__key").sortWithinPartitions("__at", "__key").select("__row.*")
