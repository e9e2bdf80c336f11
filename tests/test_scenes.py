from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.operators import tree
from orrery.sources import scenes


def test_flatten_is_a_tree(spark):
    scene = {"kind": "composition", "children": [{"kind": "shot", "props": {"from": 20}, "children": [{"kind": "text"}]}, {"kind": "image"}]}
    nodes = scenes.flatten(spark, scene)
    assert [(r["node_id"], r["parent_id"], r["kind"]) for r in nodes.orderBy("node_id").collect()] == [(0, None, "composition"), (1, 0, "shot"), (2, 1, "text"), (3, 0, "image")]
    assert tree.violations(nodes).isEmpty()
    assert [r["node_id"] for r in tree.descend(nodes).orderBy("path").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="kind"):
        scenes.flatten(spark, {"children": []})


def test_positions_show_what_has_no_partner(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("ABC")], "k int, i int, word string")
    cues = spark.createDataFrame([(1, 5), (1, 9)], "k int, at int")
    got = {(r["position"], r["word"], r["at"]) for r in scenes.by_position(words, cues, ["k"], ["i"], ["at"]).collect()}
    assert got == {(0, "A", 5), (1, "B", 9), (2, "C", None)}


@pytest.mark.parametrize("n", [2, 20])
def test_winner_comes_again(spark, n):
    items = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("item"))
    cards = scenes.ranking_cards(items, ["k"], ["item"]).orderBy("card").collect()
    assert len(cards) == n + 1 and cards[0]["item"] == cards[-1]["item"] == 0
