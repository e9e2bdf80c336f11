"""Half-open intervals over frames: shots, cues, segments, pages and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeline import milliseconds_to_frames

SAFE = (1 << 53) - 1


def mount_phase(frame: Column, start: Column, duration: Column, premount: Column) -> Column:
    """active in [start, start + duration), premount in [start - premount, start), else inactive."""
    active = (frame >= start) & (frame < start + duration)
    return F.when(active, "active").when((frame >= start - premount) & (frame < start), "premount").otherwise("inactive")


def is_active(frame: Column, start: Column, duration: Column) -> Column:
    return (frame >= start) & (frame < start + duration)


def is_visible(frame: Column, start: Column, duration: Column, premount: Column) -> Column:
    return (frame >= start - premount) & (frame < start + duration)


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, how: str = "inner", salts: int = 1) -> DataFrame:
    """points with the intervals [start, end) that hold them, as an equi-join on bins.

    Every interval goes to each bin of the given width that it meets, a point to its own; the bins are
    the join's key, so neither side is broadcast and no nested loop runs, whatever their sizes. Pick a
    width near the usual length. Where points crowd into few bins, `salts` deals each bin's points to so many
    tasks, with a copy of its intervals each. Empty and null intervals hold nothing.
    """
    if width <= 0 or salts < 1:
        raise ValueError("the width of a bin is positive, and so is the number of salts")
    bin_of = lambda x: F.floor(x / float(width)).cast("long")
    proper = intervals.filter(F.col(end) > F.col(start))
    last = F.when(F.col(end) % float(width) == 0, bin_of(F.col(end)) - 1).otherwise(bin_of(F.col(end)))
    binned = proper.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(start)), F.greatest(bin_of(F.col(start)), last))))
    keyed = points.withColumn("__at", bin_of(F.col(at)))
    inside = (F.col("__at") == F.col("__bin")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    if salts > 1:
        # Any dealing of points is right, since every salt has all intervals.
        keyed = keyed.withColumn("__deal", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        binned = binned.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        inside = inside & (F.col("__deal") == F.col("__salt"))
    return keyed.join(binned, inside, how).drop("__at", "__bin", "__deal", "__salt")


def presence(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """points with n_present: how many of the intervals [start, end) hold each, without pairing them.

    An interval is +1 where it starts and -1 where it ends, summed by place before anything is shuffled;
    running sums are taken within bins of the given width, on top of the sums of the bins before. Points are
    counted by place too, each place once. Empty and null intervals hold nothing. The different places in one bin, not
    the intervals or points, bound a task; one row for each bin meets in one.
    """
    place = F.col(at).cast("double")
    places = points.select(place.alias("__place")).filter("__place IS NOT NULL").distinct()
    found = _presence(places, intervals, "__place", start, end, width)
    rows = points.join(found.withColumnRenamed("n_present", "__n"), place == F.col("__place"), "left")
    return rows.select(*points.columns, F.coalesce("__n", F.lit(0)).cast("long").alias("n_present"))


def _presence(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """The same for points of which each place has one."""
    bin_of = lambda x: F.floor(x / float(width)).cast("long")
    proper = intervals.filter(F.col(end) > F.col(start))
    steps = proper.select(F.explode(F.array(F.struct(F.col(start).cast("double").alias("x"), F.lit(1).alias("d")), F.struct(F.col(end).cast("double").alias("x"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(F.col("s.x").alias("__x")).agg(F.sum("s.d").alias("__d")).withColumn("__bin", bin_of(F.col("__x")))
    bins = steps.groupBy("__bin").agg(F.sum("__d").alias("__sum"))
    there = points.select(*points.columns, F.col(at).cast("double").alias("__x"), F.lit(0).cast("long").alias("__d"), bin_of(F.col(at)).alias("__bin"), F.lit(1).alias("__side"))
    steps = steps.select(*(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns), "__x", "__d", "__bin", F.lit(0).alias("__side"))
    inside = Window.partitionBy("__bin").orderBy("__x", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = steps.unionByName(there).withColumn("__inside", F.sum("__d").over(inside)).filter("__side = 1")
    wanted = there.select("__bin", F.lit(0).cast("long").alias("__sum")).distinct()
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = bins.unionByName(wanted).groupBy("__bin").agg(F.sum("__sum").alias("__sum")).select("__bin", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    found = both.join(bases, "__bin", "left")
    return found.select(*points.columns, (F.coalesce("__inside", F.lit(0)) + F.coalesce("__base", F.lit(0))).alias("n_present"))


def as_of(points: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, step_at: str, value: str) -> DataFrame:
    """points with the value of the latest step at or before them within their keys: one sort of the
    union of both by key and time, instead of a range join."""
    cols = points.columns
    left = points.select(*cols, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(steps.schema[value].dataType).alias("__value"))
    right = steps.select(*(F.col(c) if c in keys else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols), F.col(step_at).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn(value, F.last("__value", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*cols, value)


def cue_violations(cues: DataFrame, keys: Sequence[str], index: str = "idx", appear: str = "appear_frame", disappear: str = "disappear_frame", group: int = 4) -> DataFrame:
    """cues with group_size and slot, and which of the rules of a cue sheet each breaks: `ordered`,
    `shared_end` within its group, `handed_off` from the group before."""
    order = Window.partitionBy(*keys).orderBy(index)
    start = F.floor(F.col(index) / group)
    groups = Window.partitionBy(*keys, start)
    in_group = groups.orderBy(index)
    return cues.select(
        *cues.columns,
        F.count(F.lit(1)).over(groups).cast("int").alias("group_size"),
        (F.col(index) - start * group).cast("int").alias("slot"),
        F.coalesce(F.col(appear) < F.lag(appear).over(order), F.lit(False)).alias("ordered"),
        (F.col(disappear) != F.first(disappear).over(in_group)).alias("shared_end"),
        F.coalesce((F.col(index) % group == 0) & (F.lag(disappear).over(order) != F.col(appear)), F.lit(False)).alias("handed_off"),
    )


def segments_from_ends(rows: DataFrame, keys: Sequence[str], index: Sequence[str], end_ms: str, fps: float) -> DataFrame:
    """rows with from_frame, to_frame and frames: a segment starts where the one before it ends, and
    both bounds are rounded on their own."""
    order = Window.partitionBy(*keys).orderBy(*index)
    start = F.coalesce(F.lag(end_ms).over(order), F.lit(0.0))
    first, last = milliseconds_to_frames(start, fps), milliseconds_to_frames(F.col(end_ms), fps)
    return rows.select(*rows.columns, first.cast("long").alias("from_frame"), last.cast("long").alias("to_frame"), (last - first).cast("long").alias("frames"))


def pages(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int = 4, step: int = 6, length: int = 72) -> DataFrame:
    """rows with rank, page, slot, and the staggered start and duration of their card."""
    w = Window.partitionBy(*keys).orderBy(*order)
    number = F.row_number().over(w) - 1
    slot = F.pmod(number, F.lit(size))
    return rows.select(*rows.columns, (number + 1).alias("rank"), F.floor(number / size).cast("int").alias("page"), slot.alias("slot"), (slot * step).alias("start"), (length - slot * step).alias("duration"))


def page_totals(items: Column, size: int = 4, length: int = 72, overlap: int = 20, closing: int = 60) -> Column:
    """Frames of a ranking of so many items: its pages, where the transition starts, and the whole."""
    whole = F.ceil(items / size) * length
    return F.struct(whole.cast("long").alias("ranking"), (whole - overlap).cast("long").alias("transition"), (whole - overlap + closing).cast("long").alias("duration"))


def bucket(frame: Column, width: float) -> Column:
    """Which bucket of frames, also of a fractional width, a frame is in."""
    return F.floor(frame / float(width)).cast("long")


def round_robin(items: Column, index: Column) -> Column:
    return F.element_at(items, (F.pmod(index, F.size(items).cast("long")) + 1).cast("int"))


def running_offsets(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width: str, gap: float = 18) -> DataFrame:
    """rows with x: where each stands in a run of glyphs with a gap behind each."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("x", F.coalesce(F.sum(F.col(width) + gap).over(before), F.lit(0.0)))


def run_width(widths: Column, gap: float = 18) -> Column:
    total = F.aggregate(widths, F.lit(0.0), lambda a, w: a + w)
    return total + F.greatest(F.lit(0), F.size(widths) - 1) * gap


def repeated_values(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, with the number of values and of distinct ones, where they differ; nulls don't count."""
    found = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.countDistinct(value).alias("n_distinct"))
    return found.filter("n <> n_distinct")


def grid(spark, rows: int, columns: int) -> DataFrame:
    """row, col and parity of a grid of fixed size: the one product of two sides that is meant."""
    cells = spark.range(rows * columns)
    r, c = F.floor(F.col("id") / columns).cast("int"), (F.col("id") % columns).cast("int")
    return cells.select(r.alias("row"), c.alias("col"), ((r + c) % 2).alias("parity"))


def grids(rows: DataFrame, height: Column, width: Column) -> DataFrame:
    """rows with row, col and parity: for each row the cells of a grid of its own size, by explosion."""
    cells = rows.withColumn("__w", width).withColumn("__cell", F.explode(F.when(height * width > 0, F.sequence(F.lit(0), (height * width - 1).cast("int")))))
    r, c = F.floor(F.col("__cell") / F.col("__w")).cast("int"), (F.col("__cell") % F.col("__w")).cast("int")
    return cells.select(*rows.columns, r.alias("row"), c.alias("col"), ((r + c) % 2).alias("parity"))


def thirds(frame: Column, duration: Column) -> Column:
    """struct(segment 0..2, local) of a frame among three equal parts of a duration; the last takes the rest."""
    part = duration / 3
    segment = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.try_divide(frame, part)))).cast("int")
    return F.struct(segment.alias("segment"), (frame - segment * part).alias("local"))


def tail(values: Column, skip: int = 1) -> Column:
    """An array without its first elements."""
    return F.slice(values, skip + 1, F.greatest(F.lit(0), F.size(values) - skip))


def premount_style(frame: Column, start: Column, duration: Column, premount: Column) -> Column:
    """How a shot is there: `active`, `premounted` (hidden and held at its first frame) or `absent`."""
    return F.when((frame >= start) & (frame < start + duration), "active").when((frame >= start - premount) & (frame < start), "premounted").otherwise("absent")


def targets(rows: DataFrame, key: Sequence[str], *lists: str) -> DataFrame:
    """key, place and target: the elements of several lists of targets, one list after the other."""
    whole = F.flatten(F.array(*(F.coalesce(c, F.array()) for c in lists))) if len(lists) > 1 else F.col(lists[0])
    return rows.select(*key, F.posexplode(whole).alias("place", "target"))
