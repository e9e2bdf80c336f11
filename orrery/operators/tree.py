"""Ordered trees held as rows (node_id, parent_id, ord, ...).

What a node takes from the line above it is folded by lines that double in length (`lift`), what it takes from below is
summed by jumps that do (`sized`), and subtrees are ranges of pre-order numbers, which both give (`toured`): as many steps
as the logarithm of the depth, each of equi-joins whose rows are kept before the next. Only `descend`, which carries what isn't associative, and
paths, goes level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables


def descend(nodes: DataFrame, carry: dict[str, tuple[Column, Column]] | None = None, most: int = 10_000) -> DataFrame:
    """nodes with depth and path (the ord of every ancestor and its own: ascending paths are
    pre-order), and whatever else is carried down.

    carry: for each name, the value at a root, and the value at a child, where `parent` is the name of
    the carried value of its parent, as a column `parent_<name>`.
    Nodes that no root leads to, such as those of a cycle, are left out: see `unreached`. Raises
    RuntimeError beyond `most` levels.
    """
    carry = carry or {}
    roots = nodes.filter("parent_id IS NULL")
    level = tables.kept(roots.select(*nodes.columns, F.lit(0).alias("depth"), F.array("ord").alias("path"), *(at_root.alias(n) for n, (at_root, _) in carry.items())))
    out = level
    for _ in range(most):
        above = level.select(F.col("node_id").alias("__parent"), F.col("depth").alias("__depth"), F.col("path").alias("__path"), *(F.col(n).alias(f"parent_{n}") for n in carry))
        below = nodes.join(above, F.col("parent_id") == F.col("__parent"))
        level = tables.kept(below.select(*nodes.columns, (F.col("__depth") + 1).alias("depth"), F.concat("__path", F.array("ord")).alias("path"), *(at_child.alias(n) for n, (_, at_child) in carry.items())))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"the tree has more than {most} levels")


Fold = tuple[Column, Callable[[Column, Column], Column]]
#: Children of one parent, or more, that make it worth to let Spark split skewed joins, at some jobs a step.
MANY_CHILDREN = 100_000


def skewed(nodes: DataFrame) -> bool:
    """Whether a node has very many children."""
    most = nodes.filter("parent_id IS NOT NULL").groupBy("parent_id").count().agg(F.max("count")).first()[0]
    return (most or 0) >= MANY_CHILDREN


#: Rows that a side of a join may have for it to be sent to all tasks: some MB.
FEW = 50_000


def matched(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", few: bool = False) -> DataFrame:
    """A join that sends the right side to all tasks if its rows are known to be few, and never by a guess of Spark's:
    sizes of files say little about rows whose keys are made from them."""
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def inner_or_parent() -> Column:
    """The node whose sums give a node's place: itself where it has children, and else its parent."""
    return F.when(F.col("__kids").isNotNull(), F.col("node_id")).otherwise(F.col("parent_id"))


def spread(going: Column) -> Column:
    """0 for a row that looks for another, and else a number of many, so that rows that look for none share no task."""
    return F.when(going, 0).otherwise(1 + F.pmod(F.hash("node_id"), F.lit(4096)))


def asked(step: int) -> bool:
    """Whether to look if a loop of doubling steps is done: often at first, since most trees are shallow."""
    return step < 4 or step % 4 == 0


def lift(nodes: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """nodes with depth, root_id, and for each name the fold of the line from the root down to the node.

    folds: the value of a node alone, and how the value of a line's upper part combines with that of its lower
    part; that has to be associative. Lines are joined with the lines above them, twice as long at each step, so that
    the number of steps is the logarithm of the depth. Nodes that no root leads to are left out, see `unreached`.
    """
    return lines(nodes, folds).filter("up IS NULL").drop("up", "steps").withColumnRenamed("height", "depth")


def lines(nodes: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """What `lift` is made of, with the nodes on cycles and below them too: for these `up` stays."""
    hot, names = skewed(nodes), list(folds)
    ids = nodes.select(F.col("node_id").alias("__id"), F.lit(0).alias("__spread"))
    rows = nodes.withColumns({"up": F.col("parent_id"), "height": F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long"), "root_id": F.col("node_id"), **{n: own for n, (own, _) in folds.items()}})
    # An orphan's line has no upper end, and never gets one.
    rows = tables.kept(matched(rows, ids, (F.col("up") == F.col("__id")) & (spread(F.col("up").isNotNull()) == F.col("__spread")), "left").withColumn("steps", F.when(F.col("up").isNotNull() & F.col("__id").isNull(), -1).otherwise(0)).drop("__id", "__spread"), hot)
    count = rows.count()
    few = count <= FEW
    for step in range(max(1, count).bit_length()):
        if asked(step) and rows.filter(F.col("up").isNotNull() & (F.col("steps") >= 0)).isEmpty():
            break
        above = rows.select(F.col("node_id").alias("__id"), F.lit(0).alias("__spread"), F.col("up").alias("__up"), F.col("height").alias("__height"), F.col("root_id").alias("__root"), F.col("steps").alias("__steps"), *(F.col(n).alias(f"__{n}") for n in names))
        going = F.col("up").isNotNull() & (F.col("steps") >= 0)
        joined = matched(rows, above, (F.col("up") == F.col("__id")) & (spread(going) == F.col("__spread")), "left", few)
        met = F.col("__id").isNotNull()
        longer = {n: F.when(met, combine(F.col(f"__{n}"), F.col(n))).otherwise(F.col(n)) for n, (_, combine) in folds.items()}
        rows = joined.withColumns(
            {
                "height": F.when(met, F.col("height") + F.col("__height")).otherwise(F.col("height")),
                "root_id": F.when(met, F.col("__root")).otherwise(F.col("root_id")),
                "steps": F.when(F.coalesce("__steps", F.lit(0)) < 0, -1).otherwise(F.col("steps")),
                "up": F.when(met, F.col("__up")).otherwise(F.col("up")),
                **longer,
            }
        )
        rows = tables.kept(rows.drop("__id", "__spread", "__up", "__height", "__root", "__steps", *(f"__{n}" for n in names)), hot)
    return rows


def unreached(nodes: DataFrame) -> DataFrame:
    """node_id of the nodes that hang on a cycle or on no root at all."""
    return lines(nodes.select("node_id", "parent_id"), {}).filter("up IS NOT NULL").select("node_id")


def inherit(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """nodes with inherited_<column>: its own value, or else that of the nearest ancestor with one."""
    return lift(nodes, {f"inherited_{c}": (F.col(c), lambda upper, lower: F.coalesce(lower, upper)) for c in columns})


def visible(nodes: DataFrame, own: Column) -> DataFrame:
    """Nodes whose ancestors are all visible, themselves included: a hidden node hides its subtree."""
    return lift(nodes, {"seen": (F.coalesce(own, F.lit(True)), lambda upper, lower: upper & lower)}).filter("seen").drop("seen")


def local_frames(nodes: DataFrame, start: Column, frame: Column) -> DataFrame:
    """nodes with local_frame: the frame, less the start of every ancestor that shifts time."""
    own = F.coalesce(start, F.lit(0)).cast("double")
    out = lift(nodes, {"shift": (own, lambda upper, lower: upper + lower)})
    return out.withColumn("local_frame", frame.cast("double") - (F.col("shift") - own)).drop("shift")


def sized(nodes: DataFrame) -> DataFrame:
    """nodes with size: how many nodes a node's subtree has, itself included; and __kids, null for a leaf.

    Only nodes with children take part in the steps: a node's sum goes to its ancestor, twice as far up at each step, so
    that the number of steps is the logarithm of the depth. Nodes that no root leads to are left out.
    """
    kids = nodes.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("__id")).agg(F.count(F.lit(1)).alias("__kids"))
    rows = tables.kept(matched(nodes, kids, F.col("node_id") == F.col("__id"), "left").drop("__id"))
    # A subtree's nodes, less its top, are the children of its nodes.
    inner = rows.filter("__kids IS NOT NULL").select("node_id", F.col("parent_id").alias("up"), F.col("__kids").alias("below"), F.lit(False).alias("lost"))
    count = inner.count()
    few, hot = count <= FEW, skewed(inner.withColumnRenamed("up", "parent_id"))
    inner = inner.coalesce(1) if few else inner
    for step in range(max(1, count).bit_length()):
        going = inner.filter("up IS NOT NULL")
        if asked(step) and going.isEmpty():
            break
        above = inner.select(F.col("node_id").alias("__id"), F.col("up").alias("__up"), F.col("lost").alias("__lost"), F.lit(0).alias("__spread"))
        ahead = matched(inner, above, (F.col("up") == F.col("__id")) & (spread(F.col("up").isNotNull()) == F.col("__spread")), "left", few)
        # What hangs on a node that isn't there is lost.
        lost = F.when(F.col("up").isNotNull(), F.coalesce("__lost", F.lit(True))).otherwise(F.col("lost"))
        ahead = ahead.select("node_id", F.col("__up").alias("up"), "below", lost.alias("lost"))
        sums = going.groupBy(F.col("up").alias("__id")).agg(F.sum("below").alias("__below"))
        summed = matched(ahead, sums, F.col("node_id") == F.col("__id"), "left", few).select("node_id", "up", (F.col("below") + F.coalesce("__below", F.lit(0))).alias("below"), "lost")
        inner = tables.kept(summed.coalesce(1) if few else summed, hot)
    reached = inner.filter("up IS NULL AND NOT lost").select(F.col("node_id").alias("__id"), (F.col("below") + 1).alias("__size"))
    tops = rows.filter("__kids IS NULL AND parent_id IS NULL").withColumn("size", F.lit(1).cast("long"))
    # A leaf is reached if its parent is.
    others = matched(rows.filter("__kids IS NOT NULL OR parent_id IS NOT NULL"), reached, inner_or_parent() == F.col("__id"), "inner", few)
    return others.select(*rows.columns, F.when(F.col("__kids").isNotNull(), F.col("__size")).otherwise(1).cast("long").alias("size")).unionByName(tops)


def toured(nodes: DataFrame) -> DataFrame:
    """nodes with entry, exit and size: a node's subtree are the nodes whose entry is in entry..exit.

    Entries number the nodes in pre-order, children by ord, and roots by ord: a node's entry is the sum, down the line to
    it, of what comes before each node among its siblings. Nodes that no root leads to are left out.
    """
    siblings = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    before = F.coalesce(F.sum("size").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tables.kept(sized(nodes).withColumn("__before", before + F.when(F.col("parent_id").isNull(), 0).otherwise(1)))
    inner = rows.filter("__kids IS NOT NULL").select("node_id", "parent_id", "__before")
    few = inner.count() <= FEW
    entries = lines(inner.coalesce(1) if few else inner, {"entry": (F.col("__before"), lambda upper, lower: upper + lower)}).select(F.col("node_id").alias("__id"), F.col("entry").alias("__entry"))
    entries = tables.kept(entries.coalesce(1)) if few else entries
    tops = rows.filter("__kids IS NULL AND parent_id IS NULL").withColumn("entry", F.col("__before"))
    others = matched(rows.filter("__kids IS NOT NULL OR parent_id IS NOT NULL"), entries, inner_or_parent() == F.col("__id"), "inner", few)
    others = others.withColumn("entry", F.col("__entry") + F.when(F.col("__kids").isNull(), F.col("__before")).otherwise(0))
    out = others.drop("__id", "__entry").unionByName(tops).drop("__kids", "__before")
    return out.withColumn("exit", F.col("entry") + F.col("size") - 1)


def contains(toured_nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (upper, lower) with contained: whether lower is upper or below it."""
    place = lambda end: toured_nodes.select(F.col("node_id").alias(end), F.col("entry").alias(f"__{end}"), F.col("exit").alias(f"__{end}_exit"))
    both = pairs.join(place("upper").hint("merge"), "upper", "left").join(place("lower").hint("merge"), "lower", "left")
    return both.select(*pairs.columns, F.coalesce(F.col("__lower").between(F.col("__upper"), F.col("__upper_exit")), F.lit(False)).alias("contained"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """node_id and size: how many nodes its subtree has, itself included."""
    return sized(nodes.select("node_id", "parent_id")).select("node_id", "size")


def subtree_sums(toured_nodes: DataFrame, value: str) -> DataFrame:
    """node_id and total: the sum of a column over each node's subtree, as a difference of running sums.

    Running sums are taken in ranges of entries, whose own totals are summed first."""
    width = 4096
    rows = toured_nodes.select("node_id", "entry", "exit", F.coalesce(F.col(value), F.lit(0)).alias("v"), F.floor(F.col("entry") / width).alias("range"))
    ranges = rows.groupBy("range").agg(F.sum("v").alias("s"))
    ranges = ranges.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("base"))
    inside = F.sum("v").over(Window.partitionBy("range").orderBy("entry"))
    run = tables.kept(rows.withColumn("inside", inside).join(ranges.hint("merge"), "range").select("node_id", "entry", "exit", "v", (F.col("inside") + F.col("base")).alias("upto")))
    ends = run.select(F.col("entry").alias("__exit"), F.col("upto").alias("__upto"))
    return matched(run, ends, F.col("exit") == F.col("__exit")).select("node_id", (F.col("__upto") - F.col("upto") + F.col("v")).alias("total"))


def violations(nodes: DataFrame) -> DataFrame:
    """node_id and rule of what isn't a tree: `duplicate`, `orphan`, `self`, `shared_place`."""
    duplicate = nodes.groupBy("node_id").count().filter("count > 1").select("node_id", F.lit("duplicate").alias("rule"))
    ids = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    orphan = nodes.filter("parent_id IS NOT NULL").join(ids, "parent_id", "left_anti").select("node_id", F.lit("orphan").alias("rule"))
    own = nodes.filter("parent_id = node_id").select("node_id", F.lit("self").alias("rule"))
    shared = nodes.groupBy("parent_id", "ord").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("node_id")).filter("n > 1").select("node_id", F.lit("shared_place").alias("rule"))
    return duplicate.unionByName(orphan).unionByName(own).unionByName(shared)

