from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import geometry, noise, sheet, text
from orrery.operators import determinism, intervals

DIM = "struct<num: double, txt: string>"
POINT = f"struct<x: {DIM}, y: {DIM}>"
STOPS = "array<struct<offset: double, color: string, unit: string>>"
TILE = f"struct<position: {POINT}, repeat: string, width: {DIM}, height: {DIM}>"
LAYER = f"struct<kind: string, color: string, angle: double, shape: string, position: {POINT}, stops: {STOPS}, repeating: boolean, source: string, fit: string, repeat: string, blend_mode: string, tile: {TILE}>"
SIDE = "struct<width: double, style: string, color: string>"
PAINT = f"struct<fill: string, stroke: string, stroke_width: double, radius: double, backgrounds: array<{LAYER}>, border: struct<top: {SIDE}, right: {SIDE}, bottom: {SIDE}, left: {SIDE}, radii: struct<top_left: double, top_right: double, bottom_right: double, bottom_left: double>>, outline: struct<width: double, style: string, color: string, offset: double>>"


def px(n):
    return (float(n), None)


def txt(s):
    return (None, s)


def made(spark, kind, value, f):
    schema = T.StructType([T.StructField("v", T._parse_datatype_string(kind))])
    return spark.createDataFrame([(value,)], schema).select(f(F.col("v")).alias("o")).first()["o"]


def layer(kind, **own):
    names = ("kind", "color", "angle", "shape", "position", "stops", "repeating", "source", "fit", "repeat", "blend_mode", "tile")
    return tuple({"kind": kind, "blend_mode": "normal", **own}.get(n) for n in names)


HALF = ((0.0, "red", "normalized"), (0.5, "blue", "normalized"))


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (layer("solid", color="red"), "linear-gradient(red, red)"),
        (layer("linear-gradient", angle=90.0, stops=HALF), "linear-gradient(90deg, red 0%, blue 50%)"),
        (layer("radial-gradient", shape="circle", position=(txt("50%"), px(4)), stops=HALF, repeating=True), "repeating-radial-gradient(circle at 50% 4px, red 0%, blue 50%)"),
        (layer("conic-gradient", angle=45.0, position=(txt("50%"), txt("40%")), stops=HALF), "conic-gradient(from 45deg at 50% 40%, red 0%, blue 50%)"),
        (layer("image", source='a"b', position=(px(0), px(0)), fit="stretch", repeat="no-repeat"), 'url("a\\"b") 0px 0px / 100% 100% no-repeat'),
    ],
)
def test_backgrounds(spark, value, want):
    assert made(spark, LAYER, value, sheet.background) == want


def test_paint(spark):
    plain = ("transparent", "black", 2.0, 8.0, None, None, None)
    assert made(spark, PAINT, plain, sheet.paint) == {"border": "2px solid black", "border-radius": "8px"}
    side, none = (3.0, "dashed", "red"), (0.0, "solid", "red")
    tiled = layer("solid", color="red", tile=((px(1), px(2)), "repeat-x", px(10), txt("auto")))
    typed = ("white", "none", 0.0, 0.0, [tiled, layer("solid", color="blue", blend_mode="screen")], (side, none, none, side, (1.0, 2.0, 3.0, 4.0)), (1.0, "solid", "lime", 5.0))
    assert made(spark, PAINT, typed, sheet.paint) == {
        "background": "linear-gradient(red, red), linear-gradient(blue, blue)", "background-blend-mode": "normal, screen", "background-position": "1px 2px, 0px 0px", "background-repeat": "repeat-x, repeat",
        "background-size": "10px auto, auto", "border-top": "3px dashed red", "border-left": "3px dashed red", "border-radius": "1px 2px 3px 4px", "outline": "1px solid lime", "outline-offset": "5px",
    }


def test_frame_and_layout(spark):
    kind = f"struct<position: string, x: {DIM}, y: {DIM}, right: {DIM}, bottom: {DIM}, width: {DIM}, height: {DIM}, min_width: {DIM}, min_height: {DIM}, max_width: {DIM}, max_height: {DIM}, aspect_ratio: double, z: string, box_sizing: string>"
    own = (None, px(3), txt("10%"), None, None, px(100), txt("auto"), None, None, None, px(9.5), 1.5, "4", None)
    want = {"position": "absolute", "left": "3px", "top": "10%", "width": "100px", "height": "auto", "max-height": "9.5px", "aspect-ratio": "1.5", "z-index": "4", "box-sizing": "border-box"}
    assert made(spark, kind, own, sheet.frame) == want
    assert made(spark, kind, ("static", *own[1:]), sheet.frame) == {k: v for k, v in want.items() if k not in ("position", "left", "top")}
    assert made(spark, kind, own, lambda f: sheet.sheet_text(sheet.frame(f))).startswith("aspect-ratio: 1.5; box-sizing: border-box; height: auto; left: 3px")
    track = f"struct<kind: string, value: {DIM}, share: double, size: string, min: string, max: string>"
    box = f"struct<mode: string, direction: string, wrap: string, align: string, justify: string, columns: array<{track}>, rows: array<{track}>, padding: struct<top: {DIM}, right: {DIM}, bottom: {DIM}, left: {DIM}>, gap: struct<row: {DIM}, column: {DIM}>>"
    flex = ("flex", "row", "nowrap", "start", None, [], [], (px(1), None, None, None), (None, px(2)))
    assert made(spark, box, flex, sheet.layout) == {"display": "flex", "align-items": "flex-start", "justify-content": "flex-start", "flex-direction": "row", "flex-wrap": "nowrap", "padding-top": "1px", "column-gap": "2px"}
    grid = ("grid", None, None, None, "end", [("fixed", px(10), None, None, None, None), ("fraction", None, 2.0, None, None, None)], [], None, None)
    assert made(spark, box, grid, sheet.layout) == {"display": "grid", "align-items": "stretch", "justify-content": "end", "grid-template-columns": "10px 2fr"}
    item = f"struct<align: string, basis: {DIM}, grow: double, shrink: double, column: struct<start: double, span: double>, row: struct<start: double, span: double>, order: double>"
    assert made(spark, item, ("end", txt("auto"), 0.0, 1.0, (2.0, 3.0), None, 4.0), sheet.layout_item) == {"align-self": "flex-end", "flex-basis": "auto", "flex-grow": "0", "flex-shrink": "1", "grid-column": "2 / span 3", "order": "4"}


def one(spark, column):
    return spark.range(1).select(column.alias("o")).first()["o"]


def test_geometry(spark):
    assert tuple(one(spark, geometry.cover_fit(F.lit(100.0), F.lit(50.0), 1080, 1920))) == (38.4, 3840.0, 1920.0)
    at = one(spark, geometry.polar(F.lit(90.0), 10, 5))
    assert (at["x"], at["y"]) == pytest.approx((15, 5))
    assert one(spark, geometry.ray_path(F.lit(5), center=0, radius=10)).startswith("M 0 0 L 10 0 A 10 10 0 0 1 9.9")
    points = one(spark, geometry.rule_points(F.lit(1), F.lit(3)))
    want = lambda k: ((x := math.sin((49 + k * 4.7) * 12.9898 + 3 * 78.233) * 43758.5453) - math.floor(x) - 0.5) * 12 + 930
    assert len(points) == 17 and [p["x"] for p in points][::8] == [110, 540, 970] and points[4]["y"] == pytest.approx(want(4), abs=1e-6)
    polygon = lambda *ps: one(spark, geometry.polygon_problem(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))))
    assert [polygon((0, 0), (1, 1)), polygon((0, 0), (1, 1), (0.5, math.nan)), polygon((0, 0), (1, 1), (0.5, 2)), polygon((0, 0), (1, 1), (0.5, 1))] == ["few", "finite", "outside", None]
    assert [s["blur"] for s in one(spark, geometry.mark_shadows(F.lit(10.0)))] == [10, 18, 30]
    assert one(spark, geometry.flash_stops(F.lit(0.25)))[0]["color"] == "rgba(93,145,255,0.25)"
    assert [g["x"] for g in one(spark, geometry.ghosts(F.lit(3.0)))] == [-3, 3]


def plain_hash(value):
    out = []

    def walk(v):
        if v is None:
            out.append("null")
        elif isinstance(v, bool):
            out.append(f"boolean:{str(v).lower()}")
        elif isinstance(v, str):
            out.extend(["string", v])
        elif isinstance(v, int | float):
            out.extend(["number", str(int(v)) if v == int(v) else str(v)])
        elif isinstance(v, list):
            out.extend(["array", str(len(v))])
            for x in v:
                out.append("item")
                walk(x)
        else:
            out.extend(["object", str(len(v))])
            for k in sorted(v):
                out.append(k)
                walk(v[k])

    walk(value)
    return out


def test_records_are_hashed_with_their_types(spark):
    kind = T._parse_datatype_string("b: boolean, a: array<struct<y: double, x: string>>, n: string")
    rows = spark.createDataFrame([(True, [(1.5, "p"), (2.0, None)], None)], kind)
    tokens = rows.select(noise.record_tokens(F.struct("b", "a", "n"), kind).alias("t")).first()["t"]
    assert tokens == plain_hash({"b": True, "a": [{"y": 1.5, "x": "p"}, {"y": 2, "x": None}], "n": None})
    other = spark.createDataFrame([(None, True, [(1.5, "p"), (2.0, None)])], "n string, b boolean, a array<struct<y: double, x: string>>")
    digest = lambda r: r.select(noise.record_hash(r, *r.columns).alias("h")).first()["h"]
    assert digest(rows) == digest(other) and len(digest(rows)) == 32


def test_deep_differences(spark):
    left = spark.createDataFrame([(1, (1.0, "a"), 0.0), (2, (1.0, "a"), 5.0), (3, (1.0, "a"), 1.0)], "k int, r struct<x: double, y: string>, z double")
    right = spark.createDataFrame([(1, ("a", 1.0), -0.0), (2, ("b", 1.0), 5.0)], "k int, r struct<y: string, x: double>, z double")
    got = {r["k"]: r["differ"] for r in determinism.disagreements(left, right, ["k"], ["r", "z"]).collect()}
    assert got == {1: ["z"], 2: ["r"], 3: ["r", "z"]}
    assert one(spark, determinism.same_value(F.lit(float("nan")), F.lit(float("nan")))) is True
    assert one(spark, determinism.same_value(F.lit(0.0), F.lit(-0.0))) is False


def test_small_operators(spark):
    assert tuple(one(spark, intervals.thirds(F.lit(65.0), F.lit(90.0)))) == (2, 5.0) and tuple(one(spark, intervals.thirds(F.lit(95.0), F.lit(90.0)))) == (2, 35.0)
    assert one(spark, intervals.tail(F.array(*map(F.lit, (1, 2, 3))))) == [2, 3] and one(spark, intervals.tail(F.array(F.lit(1)), 4)) == []
    assert [one(spark, intervals.premount_style(F.lit(f), F.lit(10), F.lit(5), F.lit(3))) for f in (6, 7, 9, 10, 14, 15)] == ["absent", "premounted", "premounted", "active", "active", "absent"]
    rows = spark.createDataFrame([(1, ["a", "b"], None), (2, None, ["c"])], "k int, p array<string>, q array<string>")
    assert {tuple(r) for r in intervals.targets(rows, ["k"], "p", "q").collect()} == {(1, 0, "a"), (1, 1, "b"), (2, 0, "c")}
    assert one(spark, text.characters(F.lit("ab c"))) == ["a", "b", " ", "c"]
    assert [one(spark, text.to_fixed(F.lit(x), 2)) for x in (1.0, 2.345, -0.5)] == ["1.00", "2.35", "-0.50"]
