"""Declarations of a style sheet from records: map<property, text>, without what says nothing.

Dimensions are structs (num, txt) as in `style`; records are structs in which null is left at its default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import style
from .text import css_string


def declared(**values: Column) -> Column:
    """The declarations whose value isn't null, in the order of their names' first mention."""
    pairs = F.array(*(F.struct(F.lit(k.rstrip("_").replace("_", "-")).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def sheet_text(declarations: Column) -> Column:
    """`a: b; c: d` in canonical order, that of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(declarations)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")


def unless(value: Column, default: str) -> Column:
    return F.when(value != default, value)


def point(p: Column) -> Column:
    """`x y` of a struct of two dimensions."""
    return F.concat_ws(" ", style.dimension(p["x"]), style.dimension(p["y"]))


def frame(f: Column) -> Column:
    """Place and size: edges count only where the position isn't static."""
    position = F.coalesce(f["position"], F.lit("absolute"))
    edge = lambda name: F.when(position != "static", style.dimension(f[name]))
    size = {c: style.dimension(f[c]) for c in ("width", "height", "min_width", "min_height", "max_width", "max_height")}
    return declared(position=unless(position, "static"), left=edge("x"), top=edge("y"), right=edge("right"), bottom=edge("bottom"), **size, aspect_ratio=style.number(f["aspect_ratio"]), z_index=unless(f["z"], "auto"), box_sizing=F.coalesce(f["box_sizing"], F.lit("border-box")))


def stops_from(background: Column) -> Column:
    return style.gradient_stops(background["stops"])


def background(b: Column) -> Column:
    """Text of one background: solid, linear-, radial- or conic-gradient, or image."""
    kind, again = b["kind"], F.when(F.coalesce(b["repeating"], F.lit(False)), "repeating-").otherwise("")
    fit = F.when(b["fit"] == "stretch", "100% 100%").otherwise(b["fit"])
    return (
        F.when(kind == "solid", style.call("linear-gradient", b["color"], b["color"]))
        .when(kind == "linear-gradient", F.concat(again, style.call("linear-gradient", style.degrees(b["angle"]), stops_from(b))))
        .when(kind == "radial-gradient", F.concat(again, style.call("radial-gradient", F.concat_ws(" at ", b["shape"], point(b["position"])), stops_from(b))))
        .when(kind == "conic-gradient", style.call("conic-gradient", F.concat(F.lit("from "), style.degrees(b["angle"]), F.lit(" at "), point(b["position"])), stops_from(b)))
        .otherwise(F.concat(F.lit("url("), css_string(b["source"]), F.lit(") "), point(b["position"]), F.lit(" / "), fit, F.lit(" "), b["repeat"]))
    )


def placed(b: Column) -> Column:
    """struct(position, repeat, size) of a background among tiled ones; tile: struct(position, repeat, width, height)."""
    tile, image = b["tile"], b["kind"] == "image"
    position = F.when(tile.isNotNull(), point(tile["position"])).when(image, point(b["position"])).otherwise("0px 0px")
    repeat = F.when(tile.isNotNull(), tile["repeat"]).when(image, b["repeat"]).otherwise("repeat")
    size = F.when(tile.isNotNull(), F.concat_ws(" ", style.dimension(tile["width"]), style.dimension(tile["height"])))
    size = size.when(image & (b["fit"] == "stretch"), "100% 100%").when(image, b["fit"]).otherwise("auto")
    return F.struct(position.alias("position"), repeat.alias("repeat"), size.alias("size"))


def backgrounds(layers: Column, fill: Column) -> Column:
    """background, its blend modes if one isn't normal, and the places if one is tiled."""
    some = F.coalesce(F.size(layers) > 0, F.lit(False))
    tiled = some & F.exists(layers, lambda b: b["tile"].isNotNull())
    each = lambda field: F.when(tiled, F.array_join(F.transform(layers, lambda b: placed(b)[field]), ", "))
    blends = F.when(some & F.exists(layers, lambda b: b["blend_mode"] != "normal"), F.array_join(F.transform(layers, lambda b: b["blend_mode"]), ", "))
    whole = F.when(some, F.array_join(F.transform(layers, background), ", ")).otherwise(unless(fill, "transparent"))
    return declared(background=whole, background_blend_mode=blends, background_position=each("position"), background_repeat=each("repeat"), background_size=each("size"))


def line(side: Column) -> Column:
    """`width style color` of a border's side; null where nothing is drawn."""
    return F.when((side["width"] > 0) & (side["style"] != "none"), F.concat_ws(" ", style.pixels(side["width"]), side["style"], side["color"]))


def outline(o: Column) -> Column:
    drawn = F.coalesce((o["width"] != 0) & (o["style"] != "none"), F.lit(False))
    return declared(outline=F.when(drawn, F.concat_ws(" ", style.pixels(o["width"]), o["style"], o["color"])), outline_offset=F.when(drawn, style.pixels(o["offset"])))


def border(p: Column) -> Column:
    """Of a paint with a typed border its sides and radii, else its stroke and radius."""
    b = p["border"]
    typed, radii = b.isNotNull(), [b["radii"][c] for c in ("top_left", "top_right", "bottom_right", "bottom_left")]
    sides = {f"border_{s}": F.when(typed, line(b[s])) for s in ("top", "right", "bottom", "left")}
    plain = F.when(~typed & (p["stroke_width"] > 0), F.concat(style.pixels(p["stroke_width"]), F.lit(" solid "), p["stroke"]))
    radius = F.when(typed, F.concat_ws(" ", *(style.pixels(r) for r in radii))).when(p["radius"] != 0, style.pixels(p["radius"]))
    return declared(border=plain, **sides, border_radius=radius)


def paint(p: Column) -> Column:
    return F.map_concat(backgrounds(p["backgrounds"], p["fill"]), border(p), outline(p["outline"]))


def inline_text(t: Column) -> Column:
    return declared(display=t["display"], margin_inline_start=style.dimension(t["margin_start"]), position=F.lit("static"), vertical_align=style.dimension(t["vertical_align"]))


def layout(v: Column) -> Column:
    """Of a flex or grid container."""
    flex = v["mode"] == "flex"
    tracks = lambda name: F.when(~flex & (F.size(v[name]) > 0), F.array_join(F.transform(v[name], style.grid_track), " "))
    aligned = lambda name, default: style.alignment(F.coalesce(v[name], F.lit(default)), flex)
    padding = {f"padding_{s}": style.dimension(v["padding"][s]) for s in ("top", "right", "bottom", "left")}
    gaps = {f"{s}_gap": style.dimension(v["gap"][s]) for s in ("row", "column")}
    return declared(
        display=v["mode"], align_items=aligned("align", "stretch"), justify_content=aligned("justify", "start"), flex_direction=F.when(flex, v["direction"]), flex_wrap=F.when(flex, v["wrap"]),
        grid_template_columns=tracks("columns"), grid_template_rows=tracks("rows"), **padding, **gaps,
    )


def layout_item(v: Column) -> Column:
    own = F.when(v["align"] == "auto", "auto").otherwise(style.alignment(F.coalesce(v["align"], F.lit("stretch")), F.lit(True)))
    place = lambda name: F.when(v[name].isNotNull(), style.grid_placement(v[name]["start"], v[name]["span"]))
    return F.when(v.isNotNull(), declared(align_self=own, flex_basis=style.dimension(v["basis"]), flex_grow=style.number(v["grow"]), flex_shrink=style.number(v["shrink"]), grid_column=place("column"), grid_row=place("row"), order=style.number(v["order"])))
