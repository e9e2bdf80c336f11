"""Digests of whole subtrees, and comparison of two versions of a tree that goes down only where they differ.

A node's digest is SHA-256 of its own record's and of its children's digests in order, made level by level from the
deepest up: a digest needs those below it, so the depth sets the number of steps. Children are hashed FAN at a
time, and these hashes again, so that no row holds all children of a node. Equal subtrees have equal digests, whoever's
they are, and an unequal pair of trees has unequal roots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from . import tree

FAN = 1024


def record_digest(*columns: str) -> Column:
    """Of a node's own record: plain columns, maps in the order of their keys."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def joined(children: DataFrame, rounds: int) -> DataFrame:
    """parent_id, n and below: how many children, and one digest of theirs in order."""
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("ord", "node_id")) - 1
    rows = children.select("parent_id", place.alias("place"), "digest", F.lit(1).cast("long").alias("n"), F.col("size"))
    for _ in range(rounds):
        group = F.floor(F.col("place") / FAN).alias("place")
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda s: s["digest"]), "")
        rows = rows.groupBy("parent_id", group).agg(F.sha2(inside.cast("binary"), 256).alias("digest"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    return rows.select("parent_id", "n", F.col("digest").alias("below"), F.col("size").alias("inner"))


def signed(nodes: DataFrame, own: Column) -> DataFrame:
    """nodes with depth, root_id, own (the record's digest), digest (the subtree's) and size (its nodes). Nodes that no
    root leads to are left out."""
    rows = tables.kept(tree.lift(nodes, {}).withColumn("own", own))
    facts = rows.agg(F.max("depth").alias("depth")).first()
    most = rows.groupBy("parent_id").count().agg(F.max("count")).first()[0] or 1
    rounds = 1
    while FAN**rounds < most:
        rounds += 1
    done, level = [], None
    for depth in range(facts["depth"] if facts["depth"] is not None else -1, -1, -1):
        here = rows.filter(F.col("depth") == depth)
        if level is None:
            here = here.withColumns({"n": F.lit(0).cast("long"), "below": F.lit(""), "inner": F.lit(0).cast("long")})
        else:
            below = joined(level.select("parent_id", "ord", "node_id", "digest", "size"), rounds).withColumnRenamed("parent_id", "__parent")
            here = here.join(below, F.col("node_id") == F.col("__parent"), "left").drop("__parent")
        whole = F.sha2(F.concat_ws("|", "own", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("below", F.lit(""))).cast("binary"), 256)
        level = tables.kept(here.select(*rows.columns, whole.alias("digest"), (F.coalesce("inner", F.lit(0)) + 1).alias("size")))
        done.append(level)
    if not done:
        return rows.withColumns({"digest": F.lit(""), "size": F.lit(0).cast("long")})
    return reduce(DataFrame.unionByName, done)


def interned(rows: DataFrame) -> DataFrame:
    """digest, size, first (the smallest node_id) and times: every different subtree once."""
    return rows.groupBy("digest").agg(F.min("size").alias("size"), F.min("node_id").alias("first"), F.count(F.lit(1)).alias("times"))


def changes(left: DataFrame, right: DataFrame, key: str = "node_id") -> DataFrame:
    """left_id, right_id, change and size for two signed trees, whose nodes are matched by key among the children of
    matched parents: `changed` where a node's own record differs, `added` and `removed` for whole subtrees, with their
    size. Subtrees with equal digests aren't looked into."""
    ends = lambda rows, side: rows.select(*(F.col(c).alias(f"{side}_{n}") for c, n in (("node_id", "id"), ("parent_id", "parent"), (key, "key"), ("own", "own"), ("digest", "digest"), ("size", "size"))))
    a, b = ends(left, "left"), ends(right, "right")
    pairs = a.filter("left_parent IS NULL").join(b.filter("right_parent IS NULL"), F.col("left_key").eqNullSafe(F.col("right_key")), "full")
    out = None
    while True:
        pairs = tables.kept(pairs.filter("left_digest IS NULL OR right_digest IS NULL OR left_digest <> right_digest"))
        out = pairs if out is None else out.unionByName(pairs)
        open_ones = pairs.filter("left_id IS NOT NULL AND right_id IS NOT NULL").select("left_id", "right_id")
        if open_ones.isEmpty():
            break
        above = open_ones.withColumnsRenamed({"left_id": "__left", "right_id": "__right"})
        lefts = a.join(above, F.col("left_parent") == F.col("__left")).drop("__right")
        rights = b.join(above, F.col("right_parent") == F.col("__right")).withColumnRenamed("__left", "__pair").drop("__right")
        pairs = lefts.join(rights, (F.col("__left") == F.col("__pair")) & F.col("left_key").eqNullSafe(F.col("right_key")), "full").select(*a.columns, *b.columns)
    change = F.when(F.col("left_id").isNull(), "added").when(F.col("right_id").isNull(), "removed").when(F.col("left_own") != F.col("right_own"), "changed")
    found = out.select("left_id", "right_id", change.alias("change"), F.coalesce("right_size", "left_size").alias("size"))
    return found.filter("change IS NOT NULL")
