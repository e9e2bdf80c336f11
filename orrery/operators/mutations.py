"""Changes of trees as a log of batches, each of which counts whole or not at all.

A row is one operation: (tree, batch, seq, op, unit, arg), with ops

    unit       arg is null; a new unit without a parent
    add        arg is the unit that becomes the last child of `unit`
    behaviour  arg is a kind; `unit` gets a behaviour of it
    remove     arg is a kind; `unit` loses its behaviour of that kind, if it has one

Batches of a tree follow one another by number, and operations by seq. A batch in which an operation breaks a rule
(`known` twice, `unknown`, `cycle`, `two_parents`, `repeated_kind`, `op`) leaves no trace. Adding a child to the parent that
it has changes nothing.

What a batch may do depends on all that count before it, so a tree's log streams through one task in order, with the
tree's state alone in memory; trees are dealt to tasks. Snapshots as of any batch are plain windows over the operations
that count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables

OUTCOME = "tree string, batch long, seq long, op string, unit string, arg string, rule string"


@dataclass
class Tree:
    """Parents of units, and their kinds of behaviours; and how to take the batch at hand back."""

    parent: dict[str, str | None] = field(default_factory=dict)
    kinds: set[tuple[str, str]] = field(default_factory=set)
    undo: list[tuple] = field(default_factory=list)

    def apply(self, op: str, unit: str | None, arg: str | None) -> str | None:
        """The rule that the operation breaks; None if it counts."""
        if op == "unit":
            if unit is None or unit in self.parent:
                return "known"
            self.parent[unit] = None
            self.undo.append(("unit", unit))
            return None
        if op not in ("add", "behaviour", "remove"):
            return "op"
        if unit not in self.parent or arg is None:
            return "unknown"
        if op == "add":
            if arg not in self.parent:
                return "unknown"
            above: str | None = unit
            while above is not None:
                if above == arg:
                    return "cycle"
                above = self.parent[above]
            if self.parent[arg] not in (None, unit):
                return "two_parents"
            if self.parent[arg] is None:
                self.parent[arg] = unit
                self.undo.append(("add", arg))
        elif op == "behaviour":
            if (unit, arg) in self.kinds:
                return "repeated_kind"
            self.kinds.add((unit, arg))
            self.undo.append(("behaviour", unit, arg))
        elif (unit, arg) in self.kinds:
            self.kinds.remove((unit, arg))
            self.undo.append(("remove", unit, arg))
        return None

    def back(self) -> None:
        for op, *what in reversed(self.undo):
            if op == "unit":
                del self.parent[what[0]]
            elif op == "add":
                self.parent[what[0]] = None
            elif op == "behaviour":
                self.kinds.discard(tuple(what))
            else:
                self.kinds.add(tuple(what))
        self.undo = []


def judged(log: DataFrame) -> DataFrame:
    """The operations with rule: that which their batch broke first, null for all operations of a batch that counts."""
    spark = log.sparkSession
    tables.importable(spark)
    names = ["tree", "batch", "seq", "op", "unit", "arg"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def played(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, current, rule, open_rows = Tree(), (None, None), None, []

        def closed() -> list[tuple]:
            if rule:
                tree.back()
            tree.undo = []
            return [(*r, rule) for r in open_rows]

        for batch in source:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if row[:2] != current:
                    out += closed()
                    if row[0] != current[0]:
                        tree = Tree()
                    current, rule, open_rows = row[:2], None, []
                rule = rule or tree.apply(*row[3:])
                open_rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*names, "rule"])
        if open_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*closed(), strict=True), kinds, strict=True)], names=[*names, "rule"])

    rows = log.select(F.col("tree").cast("string"), F.col("batch").cast("long"), F.col("seq").cast("long"), "op", F.col("unit").cast("string"), F.col("arg").cast("string"))
    placed = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree").sortWithinPartitions("tree", "batch", "seq")
    return placed.mapInArrow(played, OUTCOME)


def units_at(outcome: DataFrame, batch: int | None = None) -> DataFrame:
    """tree, unit, parent and ord (from 0, null for roots) as of a batch, or of the last."""
    rows = counted(outcome, batch)
    first = Window.partitionBy("tree", "arg").orderBy("batch", "seq")
    adds = rows.filter("op = 'add'").withColumn("n", F.row_number().over(first)).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("tree", "unit").orderBy("batch", "seq")) - 1
    adds = adds.select("tree", F.col("unit").alias("parent"), F.col("arg").alias("unit"), place.alias("ord"))
    return rows.filter("op = 'unit'").select("tree", "unit").join(adds, ["tree", "unit"], "left").select("tree", "unit", "parent", "ord")


def behaviours_at(outcome: DataFrame, batch: int | None = None) -> DataFrame:
    """tree, unit and kind of the behaviours as of a batch, or of the last."""
    rows = counted(outcome, batch).filter("op IN ('behaviour', 'remove')")
    last = rows.groupBy("tree", "unit", F.col("arg").alias("kind")).agg(F.max_by("op", F.struct("batch", "seq")).alias("op"))
    return last.filter("op = 'behaviour'").select("tree", "unit", "kind")


def counted(outcome: DataFrame, batch: int | None) -> DataFrame:
    rows = outcome.filter("rule IS NULL")
    return rows if batch is None else rows.filter(F.col("batch") <= batch)
