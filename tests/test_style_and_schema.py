from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.functions import style
from orrery.operators import schema

DIM = "struct<num: double, txt: string>"
OPERATION = f"struct<kind: string, x: {DIM}, y: {DIM}, value: {DIM}, dx: double, dy: double, dz: double, degrees: double>"


def operation(kind, x=None, y=None, value=None, dx=None, dy=None, dz=None, degrees=None):
    return (kind, x, y, value, dx, dy, dz, degrees)


def test_transforms(spark):
    pose = f"pose struct<x: double, y: double, rotate: double, skew_x: double, scale_x: double, scale_y: double, operations: array<{OPERATION}>>"
    ops = [operation("translate-2d", (None, "-50%"), (2.5, None)), operation("rotate-z", degrees=-4.0), operation("scale-2d", dx=1.0, dy=1.0), operation("scale-2d", dx=1.0, dy=2.0), operation("translate", (1.0, None), (2.0, None), dz=3.0)]
    rows = [((1.0, 0.0, 2.0, None, 1.0, 2.0, ops),), ((0.0, -0.0, 0.0, 0.0, 1.0, 1.0, []),)]
    got = [r["v"] for r in spark.createDataFrame(rows, pose).select(style.transform(F.col("pose")).alias("v")).collect()]
    assert got == ["translate3d(1px, 0px, 0) rotate(2deg) scale(1, 2) translate(-50%, 2.5px) rotateZ(-4deg) scale(1) scale(1, 2) translate3d(1px, 2px, 3px)", None]


def test_filters_and_shadows(spark):
    kind = "e struct<shadow: string, blur: double, brightness: double, contrast: double, saturate: double, filters: array<struct<kind: string, amount: double, degrees: double, x: double, y: double, blur: double, color: string, id: string>>>"
    typed = [("blur", 2.0, None, None, None, None, None, None), ("hue-rotate", None, 30.0, None, None, None, None, None), ("drop-shadow", None, None, 1.0, 2.0, 3.0, "red", None), ("svg-filter-ref", None, None, None, None, None, None, "f")]
    rows = [(("none", 0.0, 1.2, 1.0, 1.0, typed),), (("none", 0.0, 1.0, 1.0, 1.0, []),)]
    got = [r["v"] for r in spark.createDataFrame(rows, kind).select(style.filters(F.col("e")).alias("v")).collect()]
    assert got == ["brightness(1.2) blur(2px) hue-rotate(30deg) drop-shadow(1px 2px 3px red) url(#f)", None]
    stops = spark.createDataFrame([([(0.0, "red", None), (0.5, "blue", None)],)], "s array<struct<offset: double, color: string, unit: string>>")
    assert stops.select(style.linear_gradient(F.lit(90.0), F.col("s"), F.lit(True)).alias("v")).first()["v"] == "repeating-linear-gradient(90deg, red 0%, blue 50%)"


def test_defaults_and_violations(spark):
    rows = spark.createDataFrame([(1, None, 2.0, "flat", None), (2, float("nan"), 0.5, "round", "x")], "id int, rotate double, scale_x double, transform_style string, odd string")
    full = schema.with_defaults(rows, "pose").orderBy("id").first()
    assert (full["rotate"], full["scale_y"], full["backface_visibility"], full["perspective"]) == (0, 1, "visible", None)
    bad = {(r["id"], r["field"]) for r in schema.violations(rows, "pose", ["id"], closed=True).collect()}
    assert bad == {(2, "rotate"), (2, "transform_style"), (2, "odd")}
    media = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "id int, source string, volume double")
    assert {(r["id"], r["field"]) for r in schema.violations(media, "media", ["id"]).collect()} == {(2, "source"), (2, "volume")}


def test_gradient_stops(spark):
    kind = "id int, stops array<struct<offset: double, unit: string>>"
    rows = [(1, [(0.0, None), (1.0, None)]), (2, [(0.5, None)]), (3, [(0.5, None), (0.2, None)]), (4, [(0.0, None), (9.0, "px")]), (5, [(0.0, None), (2.0, None)])]
    got = {(r["id"], r["rule"]) for r in schema.stop_violations(spark.createDataFrame(rows, kind), ["id"]).collect()}
    assert got == {(2, "few"), (3, "order"), (4, "units"), (5, "range")}


def test_nested_fields_and_rules_across(spark):
    layout = spark.createDataFrame([(1, "grid", "middle", [("fraction", 0.0), ("auto", None)]), (2, "flex", None, [("fraction", 1.0)]), (3, "row", "end", None)], "id int, mode string, align string, columns array<struct<kind: string, share: double>>")
    tracks = F.transform("columns", lambda c: F.struct(c["kind"].alias("kind"), F.lit(None).cast("struct<num: double, txt: string>").alias("value"), c["share"].alias("share"), *(F.lit(None).cast("string").alias(n) for n in ("size", "min", "max"))))
    assert {tuple(r) for r in schema.violations(layout.withColumn("columns", tracks), "layout", ["id"]).collect()} == {(1, "align"), (1, "columns"), (3, "mode")}
    videos = spark.createDataFrame([(1, "a", 5.0, 5.0, "auto", True), (2, "b", 5.0, 6.0, "video", True), (3, "c", 0.0, None, None, None)], "id int, source string, start_from double, end_at double, backend string, transparent boolean")
    assert {tuple(r) for r in schema.across_violations(videos, "video", ["id"]).collect()} == {(1, "end_at"), (2, "transparent")}
    dim = "struct<num: double, txt: string>"
    frames = spark.createDataFrame([(1, None, None, None), (2, None, (4.0, None), None), (3, (1.0, None), (4.0, None), None), (4, None, None, (7.0, "x"))], f"id int, x {dim}, right {dim}, width {dim}")
    got = {r["id"]: (r["x"], r["width"]) for r in schema.frame_defaults(frames).collect()}
    assert got == {1: ((0.0, None), (None, "100%")), 2: (None, (None, "100%")), 3: ((1.0, None), None), 4: ((0.0, None), (7.0, "x"))}
    assert {tuple(r) for r in schema.violations(frames, "frame", ["id"]).collect()} == {(4, "width")}
    shots = spark.createDataFrame([(1, 2.0**53, 1.0, "ok-1"), (2, 0.0, 3.0, "-no")], "id int, `from` double, duration double, reconciliation_key string")
    assert {tuple(r) for r in schema.violations(shots, "shot", ["id"]).collect()} == {(1, "from"), (2, "reconciliation_key")}
    assert {tuple(r) for r in schema.across_violations(shots, "shot", ["id"]).collect()} == {(1, "mount_range")}


@pytest.mark.parametrize("name", sorted(schema.SCHEMAS))
def test_defaults_keep_their_rules(spark, name):
    rows = schema.with_defaults(spark.range(1).withColumn("source", F.lit("a")), name)
    assert schema.violations(rows, name, ["id"]).isEmpty()
    assert schema.struct_type(name).fieldNames() == [f.name for f in schema.SCHEMAS[name]]
