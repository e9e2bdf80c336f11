"""Scenes as rows: nested descriptions flattened to node tables, and positional joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "node_id long, parent_id long, ord int, kind string, props map<string, string>"


def flatten(spark: SparkSession, scene: dict[str, Any]) -> DataFrame:
    """(node_id, parent_id, ord, kind, props) of a nested {kind, props, children}, numbered in pre-order.
    A scene is an authored description, of a size that fits a page; ValueError without a kind."""

    def walk(node: dict[str, Any], parent: int | None, place: int, number: Iterator[int]) -> Iterator[tuple]:
        if not node.get("kind"):
            raise ValueError("every node has a kind")
        own = next(number)
        yield own, parent, place, node["kind"], {k: str(v) for k, v in node.get("props", {}).items()}
        for i, child in enumerate(node.get("children", ())):
            yield from walk(child, own, i, number)

    return spark.createDataFrame(list(walk(scene, None, 0, iter(range(1 << 62)))), NODES)


def by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column | str], right_order: Sequence[Column | str]) -> DataFrame:
    """The i-th row of left with the i-th of right within their keys; what has no partner stays, with
    nulls, so that lengths that differ show."""
    number = lambda rows, order: rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return number(left, left_order).join(number(right, right_order), [*keys, "position"], "full")


def ranking_cards(items: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """items with card, and the winner (the first) once more behind all others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cards = items.withColumn("card", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    again = cards.filter("card = 1").withColumn("card", F.col("n") + 1)
    return cards.unionByName(again.withColumn("card", F.col("card").cast("int"))).drop("n")
