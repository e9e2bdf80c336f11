"""Scenes at frames: which nodes are there, what their laws make of them, and the nested result.

A node may shift time and bound it (`start`, `length`, `premount`, null where it doesn't). A law gives its
node channels; later laws of a node override a channel, and what a law gives as `add_x` or `times_x` is added
to x or multiplies it. Frames come from a range, so that the grid of nodes and frames is an explosion and not a
join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..laws import catalogue as laws
from ..laws import flash, impact, panels  # noqa: F401  their laws join the catalogue
from ..laws.terms import ARGUMENTS, with_arguments
from . import determinism, merkle, tree

CHANNELS = "array<struct<channel: string, number: double, text: string>>"


def spans(nodes: DataFrame) -> DataFrame:
    """nodes with depth, shift (the sum of starts above) and first and last (exclusive): the frames at
    which neither the node nor anything above it is out of its time."""
    start = F.coalesce("start", F.lit(0)).cast("long")
    open_from = F.when(F.col("length").isNotNull(), start - F.coalesce("premount", F.lit(0)))
    far = 1 << 53
    own = F.struct(start.alias("shift"), F.coalesce(open_from, F.lit(-far)).cast("long").alias("first"), F.coalesce(start + F.col("length"), F.lit(far)).cast("long").alias("last"))
    # Of a line: how far it shifts time in all, and when it is open in the time above it.
    meet = lambda upper, lower: F.struct(
        (upper["shift"] + lower["shift"]).alias("shift"), F.greatest(upper["first"], upper["shift"] + lower["first"]).alias("first"), F.least(upper["last"], upper["shift"] + lower["last"]).alias("last")
    )
    out = tree.lift(nodes, {"span": (own, meet)})
    return out.withColumns({"shift": F.col("span.shift") - start, "first": F.col("span.first"), "last": F.col("span.last")}).drop("span")


def at_frames(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """A row for each node of `spans` and each frame first..last at which it is there, with local_frame."""
    low, high = F.greatest(F.col("first"), F.lit(first)), F.least(F.col("last") - 1, F.lit(last))
    there = nodes.filter(low <= high).withColumn("frame", F.explode(F.sequence(low, high)))
    return there.withColumn("local_frame", (F.col("frame") - F.col("shift")).cast("double"))


def channels(placed: DataFrame, attached: DataFrame, fps: float, duration: float) -> DataFrame:
    """frame, node_id, channel, number, text: what the laws (node_id, ord, law) make of placed nodes.

    The laws in use are read first: a scene is authored, and has no more of them than the catalogue.
    ValueError for one that isn't in it (see laws.unknown). Arguments of laws are columns of `attached`, see
    laws.terms.ARGUMENTS."""
    used = sorted(r["law"] for r in attached.select("law").distinct().collect())
    if unknown := [law for law in used if law not in laws.LAWS]:
        raise ValueError(f"no law {', '.join(unknown)}")
    rows = placed.select("frame", "node_id", F.col("local_frame")).join(attached, "node_id")
    given = [c for c in attached.columns if c in ARGUMENTS]
    context = rows.select("node_id", "ord", "law", F.col("frame").alias("at"), F.col("local_frame").alias("frame"), F.lit(float(fps)).alias("fps"), F.lit(float(duration)).alias("duration"), *given)
    context = with_arguments(context)
    own = None
    for law in used:
        made = laws.LAWS[law]()
        texts = {c for c, kind in context.select(*(t.col.alias(c) for c, t in made.items())).dtypes if kind == "string"}
        pairs = F.array(*(F.struct(F.lit(c).alias("channel"), (F.lit(None) if c in texts else t.col).cast("double").alias("number"), (t.col if c in texts else F.lit(None)).cast("string").alias("text")) for c, t in made.items()))
        own = F.when(F.col("law") == law, pairs) if own is None else own.when(F.col("law") == law, pairs)
    made = F.lit(None).cast(CHANNELS) if own is None else own
    # Renamed afterwards: an alias `frame` beside the laws would be taken for theirs inside lambdas.
    found = context.select("node_id", "ord", "at", F.explode(made).alias("c")).select(F.col("at").alias("frame"), "node_id", "ord", "c.*")
    way = F.regexp_extract("channel", "^(add|times)_", 1)
    name = F.regexp_replace("channel", "^(add|times)_", "")
    whole = found.groupBy("frame", "node_id", name.alias("channel")).agg(
        F.max_by(F.struct("number", "text"), F.when(way == "", F.col("ord"))).alias("own"),
        F.sum(F.when(way == "add", F.col("number"))).alias("more"),
        F.product(F.when(way == "times", F.col("number"))).alias("factor"),
    )
    # What no law sets is 1 if it is multiplied, else 0.
    stands = F.when(F.col("own").isNotNull(), F.col("own.number")).when(F.col("factor").isNotNull(), 1.0).otherwise(0.0)
    return whole.select("frame", "node_id", "channel", (stands * F.coalesce("factor", F.lit(1.0)) + F.coalesce("more", F.lit(0.0))).alias("number"), "own.text")


def states(placed: DataFrame, found: DataFrame) -> DataFrame:
    """placed with state: its channels as canonical JSON, in the order of their names."""
    # One value in an array, without its brackets: strings with all that JSON escapes.
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)\A\[(.*)\]\z", 1)
    finite = ~F.isnan("number") & (F.abs("number") != float("inf"))
    value = F.when(F.col("text").isNotNull(), quoted).when(F.coalesce(finite, F.lit(False)), F.col("number").cast("string")).otherwise("null")
    line = F.struct("channel", F.concat(F.lit('"'), F.col("channel"), F.lit('":'), value).alias("written"))
    written = found.groupBy("frame", "node_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.bool_or((F.col("channel") == "present") & (F.col("number") == 0)).alias("absent"))
    out = placed.join(written, ["frame", "node_id"], "left")
    return out.withColumn("state", F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<channel: string, written: string>>")), lambda x: x["written"]), ",")).withColumn("absent", F.coalesce("absent", F.lit(False))).drop("lines")


def fold(rows: DataFrame) -> DataFrame:
    """frame and scene: the nested result {kind, ...state, children} of every frame, as JSON.

    rows: frame, node_id, parent_id, ord, kind, depth, state, absent. A node that is absent, and what is
    below it, is left out. Levels are folded from the deepest up, a join for each."""
    depth = rows.agg(F.max("depth")).first()[0]
    if depth is None:
        return rows.select("frame", F.lit("").alias("scene")).limit(0)
    below: DataFrame | None = None
    for level in range(depth, -1, -1):
        own = rows.filter((F.col("depth") == level) & ~F.col("absent"))
        inner: Column = F.lit("")
        if below is not None:
            held = below.groupBy("frame", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "scene"))).alias("held"))
            own = own.join(held, ["frame", "node_id"], "left")
            inner = F.coalesce(F.array_join(F.transform("held", lambda x: x["scene"]), ","), F.lit(""))
        state = F.when(F.col("state") != "", F.concat(F.lit(","), F.col("state"))).otherwise("")
        scene = F.concat(F.lit('{"kind":"'), F.col("kind"), F.lit('"'), state, F.lit(',"children":['), inner, F.lit("]}"))
        below = tree.tables.kept(own.select("frame", "parent_id", "ord", scene.alias("scene")))
    return below.select("frame", "scene")


def evaluate(nodes: DataFrame, attached: DataFrame, first: int, last: int, fps: float = 30, duration: float = 90) -> DataFrame:
    """frame and scene for the frames first..last of a scene; nodes without time columns are always there."""
    for c in ("start", "length", "premount"):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("long"))
    placed = at_frames(spans(nodes), first, last)
    return fold(states(placed, channels(placed, attached, fps, duration)))


def project_unit(nodes: DataFrame, attached: DataFrame, node_id: int, frame: int, fps: float = 30, duration: float = 90) -> DataFrame:
    """channel, number and text of one node at one frame; no rows where it, or what it hangs on, isn't there."""
    for c in ("start", "length", "premount"):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("long"))
    own = F.col("node_id") == node_id
    return channels(at_frames(spans(nodes).filter(own), frame, frame), attached.filter(own), fps, duration).select("channel", "number", "text")


def same_traversal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two trees have the same kinds at the same places."""
    places = lambda nodes: tree.descend(nodes).select(F.col("path").cast("string").alias("path"), "kind")
    return determinism.same_rows(places(left), places(right))


def signature(nodes: DataFrame) -> DataFrame:
    """root_id, size and signature: a digest of all that makes up a tree, so that equal configurations are
    known by equal digests. nodes: as for tree.lift, with kind and props (a map); see merkle for those of subtrees."""
    entries = nodes.withColumn("__props", F.array_sort(F.map_entries("props")))
    rows = merkle.signed(entries, merkle.record_digest("kind", "__props", "ord"))
    return rows.filter("parent_id IS NULL").select("root_id", "size", F.col("digest").alias("signature"))


def session_address(scope: str, units: int = 0) -> str:
    """What an evaluation is known by: a whole frame, one unit, so many units, or nothing."""
    if scope == "frame":
        return "frame"
    if scope != "units" or units < 0:
        raise ValueError("a scope is `frame` or a number of `units`")
    return "empty" if units == 0 else "unit" if units == 1 else f"units:{units}"


def media_defaults(nodes: DataFrame) -> DataFrame:
    """nodes with resolved_backend and resolved_pause: `auto` is what the nearest shot above has chosen, and a
    video waits for its buffer if it or, by inheritance, the nearest shot with a choice says so.

    nodes: backend and pause (null where not given), is_shot."""
    shot = lambda c: F.when(F.col("is_shot"), F.col(c))
    nearest = lambda upper, lower: F.coalesce(lower, upper)
    out = tree.lift(nodes, {"set_backend": (shot("backend"), nearest), "set_pause": (shot("pause"), nearest)})
    backend = F.when((F.col("backend") == "auto") & F.col("set_backend").isNotNull(), F.col("set_backend")).otherwise(F.col("backend"))
    pause = F.coalesce("pause", F.lit(False)) | F.coalesce("set_pause", F.lit(False))
    return out.withColumns({"resolved_backend": backend, "resolved_pause": pause}).drop("set_backend", "set_pause")


def repeated_keys(nodes: DataFrame) -> DataFrame:
    """parent_id and key of siblings that share a reconciliation key."""
    return nodes.filter("key IS NOT NULL").groupBy("parent_id", "key").count().filter("count > 1").select("parent_id", "key")


def neutral() -> Column:
    """Whether a node leaves the composition's coordinates as they are, from its own records, null where it has none:
    frame (x, y, width, height, right, bottom, the least and most of both, aspect_ratio, position, sizes as text),
    pose, paint (stroke_width, and border, an array of (width, style)), padding (an array of text), layout_item.

    A node without a frame is no containing block. width and height are `100%` or those of the composition,
    which stand in the row as full_width and full_height."""
    none = lambda *cs: [F.col(c).isNull() for c in cs]
    is_zero = lambda c: F.col(c) == 0
    full = lambda own, whole: (F.col(own) == "100%") | (F.col(own) == F.col(whole).cast("string"))
    frame = [is_zero("frame.x"), is_zero("frame.y"), full("frame.width", "full_width"), full("frame.height", "full_height"), F.coalesce("frame.position", F.lit("absolute")) == "absolute"]
    frame += none(*(f"frame.{c}" for c in ("right", "bottom", "min_width", "max_width", "min_height", "max_height", "aspect_ratio")))
    borderless = is_zero("paint.stroke_width") & F.coalesce(F.forall("paint.border", lambda s: (s["width"] == 0) | (s["style"] == "none")), F.lit(True))
    pose = [is_zero(f"pose.{c}") for c in ("x", "y", "rotate", "skew_x")] + [F.col(f"pose.{c}") == 1 for c in ("scale_x", "scale_y")]
    pose += [F.coalesce("pose.operations", F.lit(0)) == 0, F.col("pose.perspective").isNull(), F.coalesce("pose.transform_style", F.lit("flat")) == "flat"]
    unpadded = F.forall("padding", lambda side: side.rlike(r"\A[+-]?0*\.?0*(px|%)?\z") & side.rlike("0"))
    rules = [*frame, F.col("paint").isNull() | borderless, F.col("pose").isNull() | reduce(and_, pose), F.col("padding").isNull() | unpadded, F.col("layout_item").isNull() | ~F.col("layout_item")]
    return F.col("frame").isNull() | reduce(and_, (F.coalesce(r, F.lit(False)) for r in rules))


def pivot_violations(nodes: DataFrame, plain: Column | None = None) -> DataFrame:
    """node_id and rule of pivots whose place isn't well defined, since it is told in the coordinates of the whole
    composition: `shifted` below an ancestor that isn't plain and stands below the nearest composition, `outside`
    where no composition is above at all. plain: a condition on an ancestor, `neutral()` unless given."""
    own = F.coalesce(neutral() if plain is None else plain, F.lit(False))
    # Of a line: whether all above its last node, back to the nearest composition, is plain; and whether there is one.
    whole = F.col("kind").startswith("composition") & (F.col("kind") != "composition-pivot")
    state = F.struct(F.lit(True).alias("clear"), F.lit(False).alias("held"), own.alias("plain"), whole.alias("whole"))
    meet = lambda upper, lower: F.struct(
        F.when(lower["held"], lower["clear"]).otherwise(lower["clear"] & (upper["whole"] | (upper["plain"] & upper["clear"]))).alias("clear"),
        (lower["held"] | upper["whole"] | upper["held"]).alias("held"), lower["plain"].alias("plain"), lower["whole"].alias("whole"),
    )
    found = tree.lift(nodes, {"line": (state, meet)}).filter("kind = 'composition-pivot'")
    rule = F.when(~F.col("line.held"), "outside").when(~F.col("line.clear"), "shifted")
    return found.select("node_id", rule.alias("rule")).filter("rule IS NOT NULL")


def text_child_violations(nodes: DataFrame) -> DataFrame:
    """node_id of children of text that aren't inline text themselves. nodes: kind, inline."""
    above = nodes.select(F.col("node_id").alias("parent_id"), F.col("kind").alias("above"))
    return nodes.join(above, "parent_id").filter((F.col("above") == "text") & ~(F.coalesce((F.col("kind") == "text") & F.col("inline"), F.lit(False)))).select("node_id")
