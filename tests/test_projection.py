from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from orrery.laws import catalogue as laws
from orrery.operators import catalog, projection, tree
from orrery.sources import builders, scenes

LISTS = ("sources", "words", "letters", "ranks", "names", "scores", "gains")
CHOICES = {"mode": "in", "variant": "plain", "frames": "6"}
RECIPES = {"terminalCrtPanel": "pixel-crt", "terminalSpeakerPanel": "soft-speaker", "terminalStatusPanel": "bevel-status", "flashPhotoShutter": "four-beat-fade", "rapidPhotoCut": "zoom-in"}


def given(name):
    return {p: ["a", "b", "c"] if p in LISTS else RECIPES[name] if p == "recipe" else CHOICES.get(p, "v") for p in builders.builders()[name].parameters}


def test_catalogue_resolves(spark):
    entries, kinds = catalog.entries(spark, "lib").cache(), catalog.kinds(spark).cache()
    assert entries.count() == 168 and kinds.select("kind").distinct().count() == kinds.count() == 240
    assert catalog.problems(entries).isEmpty() and catalog.unresolved(entries, kinds).isEmpty()
    found = catalog.find(entries, style="archival-dossier", type="unit").orderBy("place").collect()
    assert [r["id"] for r in found] == ["unit.archival-dossier.photo-mount", "unit.archival-dossier.quote-strip", "unit.archival-dossier.shutter-transition"]
    assert found[0]["import"] == "lib/units/archival-dossier/DossierPhotoMount"
    assert [r["id"] for r in catalog.find(entries, purpose="quote title").collect()] == ["unit.signal-editorial.headline-band"]
    assert catalog.find(entries, purpose="quote").isEmpty()
    layers = {r["kind"] for r in catalog.is_a(kinds, "unit.layer").collect()}
    assert {"unit.fight-zine.chart", "unit.flash-photo.plate"} <= layers and "unit.text" not in layers


@pytest.mark.parametrize("name", sorted(builders.builders()))
def test_builders_name_kinds_and_laws(name):
    kinds = {k for line in catalog.lines("kinds.txt") for k in line.split(": ")[1].split(", ")} | {"slot"}
    nodes, attached = builders.rows(name, **given(name))
    assert [n[0] for n in nodes] == list(range(len(nodes))) and all(p is None or p < i for i, p, *_ in nodes)
    assert {kind for *_, kind, _ in nodes} <= kinds
    assert {law for *_, law in attached} <= set(laws.LAWS) and [o for _, o, _ in attached] == list(range(len(attached)))
    assert len({(p, o) for _, p, o, *_ in nodes}) == len(nodes)


def test_builders_refuse_what_they_do_not_take():
    with pytest.raises(ValueError, match="takes text"):
        builders.rows("ritualOffer")
    with pytest.raises(ValueError, match="no builder"):
        builders.rows("nothing")


def test_scene_at_frames(spark):
    nodes, attached = builders.build(spark, "signalHeadlineBand", text="A HEADLINE")
    scenes_at = {r["frame"]: json.loads(r["scene"]) for r in projection.evaluate(nodes, attached, 0, 20).collect()}
    assert sorted(scenes_at) == list(range(21))
    for f in (0, 7, 20):
        root = scenes_at[f]
        assert root["kind"] == "signal-editorial.headline-band" and [c["kind"] for c in root["children"]] == ["composition-pivot", "vector-path"]
        assert [c["kind"] for c in root["children"][0]["children"]] == ["text"]
        row = spark.createDataFrame([(float(f), 30.0, 90.0)], "frame double, fps double, duration double")
        for part, law in zip(root["children"], ("signal-editorial.impact-settle", "signal-editorial.ink-rule-strike"), strict=True):
            made = laws.LAWS[law]()
            want = row.select(*(t.col.alias(c) for c, t in made.items())).first().asDict()
            assert {c: part[c] for c in want} == {c: pytest.approx(v) if isinstance(v, float) else v for c, v in want.items()}


def test_additive_laws_stand_on_what_is_there(spark):
    nodes, attached = builders.build(spark, "ritualOffer", text="x")
    placed = projection.at_frames(projection.spans(nodes.withColumns({c: F.lit(None).cast("long") for c in ("start", "length", "premount")})), 0, 30)
    got = {(r["frame"], r["channel"]): r["number"] for r in projection.channels(placed, attached, 30, 90).collect()}
    rows = spark.createDataFrame([(float(f), 30.0, 90.0) for f in range(31)], "frame double, fps double, duration double")
    deal, hop = (rows.select("frame", *(t.col.alias(c) for c, t in laws.LAWS[f"retro-ritual.{n}"]().items())).collect() for n in ("ritual-card-deal", "bone-idle-hop"))
    for a, b in zip(deal, hop, strict=True):
        assert got[a["frame"], "y"] == pytest.approx(a["y"] + b["add_y"]) and got[a["frame"], "scale_x"] == pytest.approx(a["scale_x"] * b["times_scale_x"])
        assert got[a["frame"], "opacity"] == a["opacity"]


def test_shots_bound_what_is_below_them(spark):
    nodes = spark.createDataFrame(
        [(0, None, 0, "composition", None, None, None), (1, 0, 0, "shot", 10, 20, 5), (2, 1, 0, "text", None, None, None), (3, 1, 1, "shot", 5, 100, 0), (4, 3, 0, "text", None, None, None)],
        "node_id long, parent_id long, ord int, kind string, start long, length long, premount long",
    )
    there = {(r["node_id"], r["frame"]): r["local_frame"] for r in projection.at_frames(projection.spans(nodes), 0, 60).collect()}
    span = lambda n: sorted(f for m, f in there if m == n)
    assert span(0) == list(range(61)) and span(1) == span(2) == list(range(5, 30)) and span(3) == span(4) == list(range(15, 30))
    assert there[2, 12] == 2 and there[4, 20] == 5 and there[1, 12] == 12


def test_signatures_tell_configurations_apart(spark):
    one = {"kind": "box", "props": {"a": 1, "b": 2}, "children": [{"kind": "text"}, {"kind": "image"}]}
    same = {"kind": "box", "props": {"b": 2, "a": 1}, "children": [{"kind": "text"}, {"kind": "image"}]}
    other = {"kind": "box", "props": {"a": 1, "b": 2}, "children": [{"kind": "image"}, {"kind": "text"}]}
    a, b, c = (projection.signature(scenes.flatten(spark, s)).first() for s in (one, same, other))
    assert a["size"] == 3 and a["signature"] == b["signature"] != c["signature"]
    assert [projection.session_address("frame"), *(projection.session_address("units", n) for n in (0, 1, 4))] == ["frame", "empty", "unit", "units:4"]


def test_media_defaults_and_rules(spark):
    rows = [(0, None, 0, "shot", True, "offthread-video", True, "k"), (1, 0, 0, "video", False, "auto", None, None), (2, 0, 1, "video", False, "video", False, None), (3, 0, 2, "shot", True, None, False, "x"), (4, 3, 0, "video", False, "auto", False, None), (5, 0, 3, "shot", True, None, None, "x")]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, ord int, kind string, is_shot boolean, backend string, pause boolean, key string")
    got = {r["node_id"]: (r["resolved_backend"], r["resolved_pause"]) for r in projection.media_defaults(nodes).filter("kind = 'video'").collect()}
    assert got == {1: ("offthread-video", True), 2: ("video", True), 4: ("offthread-video", False)}
    assert [tuple(r) for r in projection.repeated_keys(nodes).collect()] == [(0, "x")]
    texts = spark.createDataFrame([(0, None, 0, "text", None), (1, 0, 0, "text", True), (2, 0, 1, "text", False), (3, 0, 2, "box", True)], "node_id long, parent_id long, ord int, kind string, inline boolean")
    assert {r["node_id"] for r in projection.text_child_violations(texts).collect()} == {2, 3}
    pivots = spark.createDataFrame([(0, None, 0, "composition", 5), (1, 0, 0, "layer", 0), (2, 1, 0, "composition-pivot", 3), (3, 0, 1, "layer", 4), (4, 3, 0, "composition-pivot", 0)], "node_id long, parent_id long, ord int, kind string, x int")
    assert [tuple(r) for r in projection.pivot_violations(pivots, F.col("x") == 0).collect()] == [(4, "shifted")]
    assert tree.violations(pivots).isEmpty()


FRAME = {"x": 0.0, "y": 0.0, "width": "100%", "height": "1920", "right": None, "bottom": None, "min_width": None, "max_width": None, "min_height": None, "max_height": None, "aspect_ratio": None, "position": None}
POSE = {"x": 0.0, "y": 0.0, "rotate": 0.0, "skew_x": 0.0, "scale_x": 1.0, "scale_y": 1.0, "operations": 0, "perspective": None, "transform_style": None}
CHANGES = [
    ({}, True), ({"frame": {"x": 4.0}}, False), ({"frame": {"y": -1.0}}, False), ({"frame": {"width": "1080"}}, True), ({"frame": {"width": "1079"}}, False), ({"frame": {"height": "50%"}}, False), ({"frame": {"right": "0"}}, False),
    ({"frame": {"min_height": "1"}}, False), ({"frame": {"aspect_ratio": "1"}}, False), ({"frame": {"position": "absolute"}}, True), ({"frame": {"position": "relative"}}, False), ({"pose": {}}, True), ({"pose": {"rotate": 1.0}}, False),
    ({"pose": {"scale_y": 0.5}}, False), ({"pose": {"operations": 2}}, False), ({"pose": {"perspective": "900px"}}, False), ({"pose": {"transform_style": "preserve-3d"}}, False), ({"paint": (0.0, None)}, True), ({"paint": (1.0, None)}, False),
    ({"paint": (0.0, [(0.0, "solid"), (3.0, "none")])}, True), ({"paint": (0.0, [(2.0, "solid")])}, False), ({"padding": ["0", "0px", "0%", "-0.0px"]}, True), ({"padding": ["0", "1px", "0", "0"]}, False), ({"layout_item": True}, False), ({"layout_item": False}, True),
]


def test_pivots_by_their_ancestors_own_records(spark):
    schema = (
        "node_id long, parent_id long, ord int, kind string, frame struct<x: double, y: double, width: string, height: string, right: string, bottom: string, min_width: string, max_width: string, min_height: string, max_height: string, aspect_ratio: string, position: string>, "
        "pose struct<x: double, y: double, rotate: double, skew_x: double, scale_x: double, scale_y: double, operations: int, perspective: string, transform_style: string>, "
        "paint struct<stroke_width: double, border: array<struct<width: double, style: string>>>, padding array<string>, layout_item boolean, full_width int, full_height int"
    )
    rows, want = [(0, None, 0, "composition.archival-dossier", FRAME | {"x": 9.0}, None, None, None, None, 1080, 1920)], set()
    for k, (change, plain) in enumerate(CHANGES):
        frame, pose = FRAME | change.get("frame", {}), POSE | change["pose"] if "pose" in change else None
        box, inner, pivot = 10 * k + 1, 10 * k + 2, 10 * k + 3
        rows += [(box, 0, k, "box", frame, pose, change.get("paint"), change.get("padding"), change.get("layout_item"), 1080, 1920), (inner, box, 0, "layer", None, POSE | {"x": 5.0}, None, None, None, 1080, 1920), (pivot, inner, 0, "composition-pivot", FRAME, POSE | {"x": 70.0}, None, None, None, 1080, 1920)]
        want |= set() if plain else {(pivot, "shifted")}
    # Below a pivot that is moved; below a composition of its own; and below none.
    rows += [(901, 3, 0, "composition-pivot", FRAME, None, None, None, None, 1080, 1920), (902, 11, 1, "composition", FRAME, None, None, None, None, 1080, 1920), (903, 902, 0, "composition-pivot", FRAME, None, None, None, None, 1080, 1920)]
    rows += [(904, None, 1, "layer", FRAME, None, None, None, None, 1080, 1920), (905, 904, 0, "composition-pivot", FRAME, None, None, None, None, 1080, 1920)]
    want |= {(901, "shifted"), (905, "outside")}
    got = projection.pivot_violations(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in got.collect()} == want


def test_arguments_of_laws_come_with_the_scene(spark):
    nodes = spark.createDataFrame([(0, None, 0, "layer"), (1, 0, 0, "text")], "node_id long, parent_id long, ord int, kind string")
    attached = spark.createDataFrame([(1, 0, "outlined-word-card.word-cue-state", 3.0, 5.0, "A B C"), (1, 1, "archival-dossier.carbon-copy-cadence", None, None, "ONE TWO THREE FOUR FIVE")], "node_id long, ord int, law string, appear_frame double, disappear_frame double, text string")
    found = {r["frame"]: json.loads(r["scene"]) for r in projection.evaluate(nodes, attached, 0, 8).collect()}
    assert [f for f, s in found.items() if s["children"]] == [3, 4] and found[3]["children"][0]["text"] == "ONE TWO THREE"
    odd = attached.unionByName(spark.createDataFrame([(1, 2, "no.such-law", None, None, None)], attached.schema))
    assert [r["law"] for r in laws.unknown(odd).collect()] == ["no.such-law"]
    with pytest.raises(ValueError, match="no.such-law"):
        projection.evaluate(nodes, odd, 0, 1)


def test_one_unit_and_equal_trees(spark):
    nodes, attached = builders.build(spark, "signalHeadlineBand", text="A")
    rule = next(r["node_id"] for r in nodes.collect() if r["props"]["role"] == "rule")
    got = {r["channel"]: r["number"] for r in projection.project_unit(nodes, attached, rule, 17).collect()}
    assert got["draw_end"] == 1
    other, _ = builders.build(spark, "signalHeadlineBand", text="B")
    assert projection.same_traversal(nodes, other)
    assert projection.signature(nodes).first()["signature"] != projection.signature(other).first()["signature"]
    assert not projection.same_traversal(nodes, builders.build(spark, "ritualOffer", text="B")[0])


def test_prompt_and_kinds_of_names(spark):
    found = catalog.prompt(catalog.find(catalog.entries(spark, "lib"), style="micro-flash"), "Known:\n{catalog}\nEnd.").first()["text"].split("\n")
    assert found[0] == "Known:" and found[-1] == "End." and len(found) == 4
    assert found[1].split(" | ")[1].startswith("lib/") and " | use: " in found[1] and " | preserves: " in found[1]
    rows = spark.createDataFrame([("unit.box",), ("behaviour.a.b",), ("unit",), (None,)], "k string")
    assert [tuple(r) for r in rows.select(catalog.is_unit(F.col("k")), catalog.is_behaviour(F.col("k"))).collect()] == [(True, False), (False, True), (False, False), (False, False)]
