"""Style text from records: numbers as text, transforms, filters, shadows, gradients, grid tracks.

Records are structs in which what a kind doesn't use is null. A dimension is a struct (num, txt): a
number of pixels, or text as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .noise import number_key

#: The kinds of transform operations, filters and grid tracks. Fixed values.
OPERATIONS = ("translate", "translate-2d", "translate-x", "translate-y", "translate-z", "rotate-x", "rotate-y", "rotate-z", "rotate-3d", "scale", "scale-2d", "skew", "perspective")
FILTERS = ("blur", "brightness", "contrast", "saturate", "hue-rotate", "grayscale", "sepia", "invert", "opacity", "drop-shadow", "svg-filter-ref")
TRACKS = ("fixed", "fraction", "auto", "content", "minmax")


def number(x: Column) -> Column:
    """A number as text, whole ones without a point; minus zero is 0."""
    return F.when(x == 0, "0").otherwise(number_key(x.cast("double")))


def pixels(x: Column) -> Column:
    return F.concat(number(x), F.lit("px"))


def dimension(d: Column) -> Column:
    return F.coalesce(d["txt"], pixels(d["num"]))


def call(name: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{name}("), F.array_join(F.array(*parts), ", "), F.lit(")"))


def degrees(x: Column) -> Column:
    return F.concat(number(x), F.lit("deg"))


def operation(o: Column) -> Column:
    """Text of struct<kind, x, y, value: dimension, dx, dy, dz, degrees: double>; an unknown kind raises."""
    k = o["kind"]
    x, y, z = o["dx"], o["dy"], o["dz"]
    return (
        F.when(k == "translate", call("translate3d", dimension(o["x"]), dimension(o["y"]), pixels(z)))
        .when(k == "translate-2d", call("translate", dimension(o["x"]), dimension(o["y"])))
        .when(k == "translate-x", call("translateX", dimension(o["value"])))
        .when(k == "translate-y", call("translateY", dimension(o["value"])))
        .when(k == "translate-z", call("translateZ", dimension(o["value"])))
        .when(k == "rotate-x", call("rotateX", degrees(o["degrees"])))
        .when(k == "rotate-y", call("rotateY", degrees(o["degrees"])))
        .when(k == "rotate-z", call("rotateZ", degrees(o["degrees"])))
        .when(k == "rotate-3d", call("rotate3d", number(x), number(y), number(z), degrees(o["degrees"])))
        .when(k == "scale", call("scale3d", number(x), number(y), number(z)))
        .when((k == "scale-2d") & (x == y), call("scale", number(x)))
        .when(k == "scale-2d", call("scale", number(x), number(y)))
        .when(k == "skew", call("skew", degrees(x), degrees(y)))
        .when(k == "perspective", call("perspective", pixels(z)))
        .otherwise(F.raise_error(F.concat(F.lit("no such transform operation: "), F.coalesce(k, F.lit("null")))))
    )


def listed(parts: list[Column], more: Column | None = None) -> Column:
    """Parts joined by blanks, without null ones; null if there are none."""
    found = F.array_compact(F.array(*parts))
    found = found if more is None else F.concat(found, F.coalesce(more, F.array().cast("array<string>")))
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def transform(pose: Column) -> Column:
    """translate, rotate, skew, scale where they do something, then operations in order."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    moved = (zero(pose["x"]) != 0) | (zero(pose["y"]) != 0)
    scaled = pose["scale_x"].isNotNull() & pose["scale_y"].isNotNull() & ((pose["scale_x"] != 1) | (pose["scale_y"] != 1))
    parts = [
        F.when(moved, call("translate3d", pixels(zero(pose["x"])), pixels(zero(pose["y"])), F.lit("0"))),
        F.when(zero(pose["rotate"]) != 0, call("rotate", degrees(pose["rotate"]))),
        F.when(zero(pose["skew_x"]) != 0, call("skewX", degrees(pose["skew_x"]))),
        F.when(scaled, call("scale", number(pose["scale_x"]), number(pose["scale_y"]))),
    ]
    return listed(parts, F.transform(pose["operations"], operation))


def one_filter(f: Column) -> Column:
    """Text of struct<kind, amount, degrees, x, y, blur: double, color, id: string>."""
    k = f["kind"]
    shadow = F.concat_ws(" ", pixels(f["x"]), pixels(f["y"]), pixels(f["blur"]), f["color"])
    return (
        F.when(k == "svg-filter-ref", F.concat(F.lit("url(#"), f["id"], F.lit(")")))
        .when(k == "hue-rotate", call("hue-rotate", degrees(f["degrees"])))
        .when(k == "drop-shadow", F.concat(F.lit("drop-shadow("), shadow, F.lit(")")))
        .otherwise(F.concat(k, F.lit("("), F.when(k == "blur", pixels(f["amount"])).otherwise(number(f["amount"])), F.lit(")")))
    )


def filters(effects: Column) -> Column:
    """Shadow, blur and the grades that differ from 1, then typed filters in order."""
    plain = lambda name: F.when(effects[name] != 1, F.concat(F.lit(f"{name}("), number(effects[name]), F.lit(")")))
    parts = [
        F.when(effects["shadow"] != "none", F.concat(F.lit("drop-shadow("), effects["shadow"], F.lit(")"))),
        F.when(effects["blur"] != 0, call("blur", pixels(effects["blur"]))),
        plain("brightness"), plain("contrast"), plain("saturate"),
    ]
    return listed(parts, F.transform(effects["filters"], one_filter))


def shadows(values: Column, box: bool = False) -> Column:
    """Text of array<struct<x, y, blur, spread, color, inset>>."""
    one = lambda s: F.concat_ws(" ", F.when(F.coalesce(s["inset"], F.lit(False)), "inset"), pixels(s["x"]), pixels(s["y"]), pixels(s["blur"]), *([pixels(s["spread"])] if box else []), s["color"])
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, one), ", "))


def gradient_stops(stops: Column) -> Column:
    """Text of array<struct<offset, color, unit>>: pixels, or a share as per cent."""
    one = lambda s: F.concat_ws(" ", s["color"], F.when(s["unit"] == "px", pixels(s["offset"])).otherwise(F.concat(number(s["offset"] * 100), F.lit("%"))))
    return F.array_join(F.transform(stops, one), ", ")


def linear_gradient(angle: Column, stops: Column, repeating: Column) -> Column:
    return F.concat(F.when(repeating, "repeating-").otherwise(""), F.lit("linear-gradient("), degrees(angle), F.lit(", "), gradient_stops(stops), F.lit(")"))


def grid_track(track: Column) -> Column:
    """Text of struct<kind, value: dimension, share: double, size: string, min, max: string>; the ends of
    a minmax are tracks that are text already."""
    k = track["kind"]
    return (
        F.when(k == "fixed", dimension(track["value"]))
        .when(k == "fraction", F.concat(number(track["share"]), F.lit("fr")))
        .when(k == "auto", "auto")
        .when(k == "content", F.concat(track["size"], F.lit("-content")))
        .otherwise(call("minmax", track["min"], track["max"]))
    )


def grid_placement(start: Column, span: Column) -> Column:
    return F.concat(number(start), F.lit(" / span "), number(span))


def alignment(value: Column, flex: Column) -> Column:
    return F.when(flex & value.isin("start", "end"), F.concat(F.lit("flex-"), value)).otherwise(value)


def draw_window(start: Column, end: Column) -> Column:
    """Dash array and offset that show a path from start to end, both in 0 to 1."""
    shown = F.greatest(F.lit(0.0), F.least(F.lit(1.0), end) - F.greatest(F.lit(0.0), start))
    return F.struct(shown.alias("dash"), (1 - shown).alias("gap"), (-F.greatest(F.lit(0.0), start)).alias("offset"))
