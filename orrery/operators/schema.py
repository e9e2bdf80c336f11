"""Record schemas: defaults, and what breaks them.

A schema is a list of fields with a default and a rule. `with_defaults` fills records in, `violations`
names each field whose value breaks its rule, so that a table's bad records are rows, not errors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.style import FILTERS, OPERATIONS
from ..functions.text import RECONCILIATION_KEY

Rule = Callable[[Column], Column]
SAFE = (1 << 53) - 1


def finite(x: Column) -> Column:
    return ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))


def positive(x: Column) -> Column:
    return finite(x) & (x > 0)


def non_negative(x: Column) -> Column:
    return finite(x) & (x >= 0)


def share(x: Column) -> Column:
    return finite(x) & (x >= 0) & (x <= 1)


def whole(x: Column) -> Column:
    return finite(x) & (x == F.floor(x)) & (F.abs(x) <= SAFE)


def one_of(*names: str) -> Rule:
    return lambda x: x.isin(*names)


def some_text(x: Column) -> Column:
    return F.length(x) > 0


def anything(x: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    default: object = None
    rule: Rule = anything
    required: bool = False


def numbers(rule: Rule = finite, **defaults: float | None) -> list[Field]:
    return [Field(n, "double", d, rule) for n, d in defaults.items()]


def choices(**fields: tuple[str, ...]) -> list[Field]:
    """Each with its choices, the default first."""
    return [Field(n, "string", c[0], one_of(*c)) for n, c in fields.items()]


#: A number of pixels, or text as it is; one of the two.
DIMENSION = "struct<num: double, txt: string>"


def a_dimension(x: Column) -> Column:
    return F.when(x["num"].isNull(), some_text(x["txt"])).otherwise(x["txt"].isNull() & finite(x["num"]))


def each(rule: Rule) -> Rule:
    return lambda x: F.forall(x, lambda v: F.coalesce(rule(v), F.lit(False)))


def sides(*names: str) -> Rule:
    """Every given side of a struct of dimensions is one."""
    return lambda x: F.forall(F.array(*(F.coalesce(x[n].isNull() | a_dimension(x[n]), F.lit(False)) for n in names)), lambda v: v)


def dimensions(*names: str, **defaults: str | None) -> list[Field]:
    return [Field(n, DIMENSION, d, a_dimension) for n, d in {**dict.fromkeys(names), **defaults}.items()]


def flags(**defaults: bool) -> list[Field]:
    return [Field(n, "boolean", d) for n, d in defaults.items()]


ALIGNMENTS = ("start", "center", "end", "stretch", "baseline")
JUSTIFICATIONS = ("start", "center", "end", "stretch", "space-between", "space-around", "space-evenly")
LINES = ("none", "solid", "dashed", "dotted", "double")
SHADOWS = "array<struct<x: double, y: double, blur: double, spread: double, color: string, inset: boolean>>"
SIDE = "struct<width: double, style: string, color: string>"
TRACKS = "array<struct<kind: string, value: struct<num: double, txt: string>, share: double, size: string, min: string, max: string>>"
PLACE = "struct<start: double, span: double>"


def a_shadow(x: Column) -> Column:
    return finite(x["x"]) & finite(x["y"]) & non_negative(x["blur"]) & some_text(x["color"])


def a_side(x: Column) -> Column:
    return non_negative(x["width"]) & x["style"].isin(*LINES) & some_text(x["color"])


def a_track(x: Column) -> Column:
    return F.when(x["kind"] == "fixed", a_dimension(x["value"])).when(x["kind"] == "fraction", positive(x["share"])).when(x["kind"] == "content", x["size"].isin("min", "max")).when(x["kind"] == "minmax", some_text(x["min"]) & some_text(x["max"])).otherwise(x["kind"] == "auto")


def a_place(x: Column) -> Column:
    return whole(x["start"]) & whole(x["span"]) & (x["start"] >= 1) & (x["span"] >= 1)


def opaque(x: Column) -> Column:
    """A media resource: some text without control characters."""
    return some_text(x) & ~x.rlike(r"[\x00-\x1f\x7f]")


def within(x: Column) -> Column:
    return share(x["x"]) & share(x["y"])


SOUND = [Field("source", "string", None, opaque, True), *numbers(non_negative, start_from=0), *numbers(end_at=None), *numbers(positive, playback_rate=1), *numbers(share, volume=1)]
PICTURE = [Field("source", "string", None, opaque, True), Field("fit", "string", "cover"), Field("position", "struct<x: double, y: double>", None, within)]
BLENDS = ("normal", "multiply", "screen", "overlay", "darken", "lighten", "color-dodge", "color-burn", "hard-light", "soft-light", "difference", "exclusion", "hue", "saturation", "color", "luminosity")
#: Records by name. Choices and defaults are fixed values.
SCHEMAS: dict[str, list[Field]] = {
    "composition": numbers(positive, width=1920, height=1080, duration=90, fps=30),
    "shot": [
        Field("from", "double", 0.0, whole), Field("duration", "double", 1.0, lambda x: whole(x) & (x > 0)), Field("premount_for", "double", 0.0, lambda x: whole(x) & (x >= 0)), Field("name", "string", "shot"),
        Field("reconciliation_key", "string", None, lambda x: x.rlike(RECONCILIATION_KEY)), Field("media_backend", "string", None, one_of("video", "offthread-video")), Field("pause_when_buffering", "boolean"),
    ],
    "frame": [
        *choices(position=("absolute", "relative", "static"), box_sizing=("border-box", "content-box")), *numbers(positive, aspect_ratio=None),
        *dimensions("x", "y", "right", "bottom", "width", "height", "min_width", "max_width", "min_height", "max_height"), Field("z", "string", "auto", lambda x: (x == "auto") | finite(x.try_cast("double"))),
    ],
    "paint": [
        Field("color", "string", "#ffffff", some_text), Field("fill", "string", "transparent", some_text), Field("stroke", "string", "transparent", some_text), *numbers(radius=0, stroke_width=0),
        Field("border", f"struct<top: {SIDE}, right: {SIDE}, bottom: {SIDE}, left: {SIDE}>", None, lambda x: a_side(x["top"]) & a_side(x["right"]) & a_side(x["bottom"]) & a_side(x["left"])),
        Field("outline", "struct<width: double, style: string, color: string, offset: double>", None, lambda x: a_side(x) & finite(x["offset"])),
    ],
    "pose": [
        *numbers(rotate=0, scale_x=1, scale_y=1, skew_x=0, x=0, y=0), *numbers(positive, perspective=None), *choices(transform_style=("flat", "preserve-3d"), backface_visibility=("visible", "hidden")),
        Field("origin", f"struct<x: {DIMENSION}, y: {DIMENSION}, z: double>", None, lambda x: a_dimension(x["x"]) & a_dimension(x["y"]) & finite(x["z"])),
        Field("perspective_origin", f"struct<x: {DIMENSION}, y: {DIMENSION}>", None, lambda x: a_dimension(x["x"]) & a_dimension(x["y"])), Field("operations", "array<struct<kind: string>>", None, each(lambda x: x["kind"].isin(*OPERATIONS))),
    ],
    "effects": [
        *numbers(blur=0, brightness=1, contrast=1, saturate=1), Field("shadow", "string", "none", some_text), *choices(blend_mode=BLENDS, isolation=("auto", "isolate")),
        Field("filters", "array<struct<kind: string>>", None, each(lambda x: x["kind"].isin(*FILTERS))), Field("backdrop_filters", "array<struct<kind: string>>", None, each(lambda x: x["kind"].isin(*FILTERS))), Field("box_shadows", SHADOWS, None, each(a_shadow)),
    ],
    "typography": [
        Field("align", "string", "left", some_text), Field("family", "string", "Inter, sans-serif", some_text), Field("style", "string", "normal", some_text), Field("transform", "string", "none", some_text), *numbers(letter_spacing=0, line_height=1, size=48, weight=400),
        Field("fill", "struct<kind: string, blend_mode: string>", None, lambda x: x["kind"].isin("linear-gradient", "radial-gradient", "conic-gradient") & (F.coalesce(x["blend_mode"], F.lit("normal")) == "normal")),
        Field("paint_order", "array<string>", None, lambda x: (F.size(F.array_distinct(x)) == F.size(x)) & F.forall(x, lambda v: v.isin("fill", "stroke", "markers"))),
        Field("stroke", "struct<width: double, color: string>", None, lambda x: non_negative(x["width"]) & some_text(x["color"])), Field("shadows", SHADOWS, None, each(a_shadow)),
        *choices(white_space=("normal", "nowrap", "pre", "pre-wrap", "pre-line", "break-spaces"), word_break=("normal", "break-all", "keep-all", "break-word"), overflow_wrap=("normal", "break-word", "anywhere"), text_overflow=("clip", "ellipsis")),
    ],
    "layout": [
        *choices(mode=("flex", "grid"), direction=("row", "row-reverse", "column", "column-reverse"), wrap=("nowrap", "wrap", "wrap-reverse")), Field("align", "string", "stretch", one_of(*ALIGNMENTS)), Field("justify", "string", "start", one_of(*JUSTIFICATIONS)),
        Field("gap", f"struct<row: {DIMENSION}, column: {DIMENSION}>", None, sides("row", "column")), Field("padding", f"struct<top: {DIMENSION}, right: {DIMENSION}, bottom: {DIMENSION}, left: {DIMENSION}>", None, sides("top", "right", "bottom", "left")),
        Field("columns", TRACKS, None, each(a_track)), Field("rows", TRACKS, None, each(a_track)),
    ],
    "layout_item": [*numbers(non_negative, grow=0, shrink=1), Field("order", "double", 0.0, whole), *dimensions("basis"), *choices(align=("auto", *ALIGNMENTS)), Field("column", PLACE, None, a_place), Field("row", PLACE, None, a_place)],
    "visual": [*numbers(opacity=1), *flags(present=True), Field("overflow", "string", "visible", some_text)],
    "audio": [*SOUND, *flags(muted=False, loop=False)],
    "image": [*PICTURE, *choices(decode=("auto", "async", "sync"))],
    "video": [*PICTURE, *SOUND[1:], *choices(backend=("auto", "video", "offthread-video")), *flags(muted=True, loop=False, pause_when_buffering=False, transparent=False)],
    "layer": [Field("name", "string", "layer")],
    "box": [Field("name", "string", "box")],
    "composition_pivot": numbers(x=None, y=None),
    "inline": [*choices(display=("inline", "inline-block"), vertical_align=("baseline", "sub", "super", "text-top", "text-bottom", "middle", "top", "bottom")), *numbers(margin_start=0)],
    "media": [Field("source", "string", None, lambda x: some_text(x) & ~x.rlike(r"[\x00-\x1f\x7f]"), True), *numbers(non_negative, start_from=0, end_at=None), *numbers(positive, playback_rate=1), *numbers(share, volume=1)],
}


#: Rules that take more than one field: of rows with defaults. A frame is told by x or left, not both.
ACROSS: dict[str, dict[str, Callable[[], Column]]] = {
    "audio": {"end_at": lambda: F.col("end_at").isNull() | (F.col("end_at") > F.col("start_from"))},
    "video": {"end_at": lambda: F.col("end_at").isNull() | (F.col("end_at") > F.col("start_from")), "transparent": lambda: ~(F.col("transparent") & (F.col("backend") == "video"))},
    "shot": {"mount_range": lambda: (F.abs(F.col("from") - F.col("premount_for")) <= SAFE) & (F.abs(F.col("from") + F.col("duration")) <= SAFE)},
}


def across_violations(rows: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """key and rule of rows whose fields break a rule together."""
    filled = with_defaults(rows, name)
    return filled.select(*key, F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(met(), F.lit(False)), F.lit(rule)) for rule, met in ACROSS[name].items())))).alias("rule"))


def frame_defaults(rows: DataFrame) -> DataFrame:
    """Frames with x and y at 0 and the whole width and height, except where the opposite edge says otherwise."""
    rows = with_defaults(rows, "frame")
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(None).cast("string").alias("txt"))
    whole_size = F.struct(F.lit(None).cast("double").alias("num"), F.lit("100%").alias("txt"))
    begin = lambda c, end: F.when(F.col(c).isNull() & F.col(end).isNull(), zero).otherwise(F.col(c))
    size = lambda c, at, end: F.when(F.col(c).isNull() & ~(F.col(at).isNotNull() & F.col(end).isNotNull()), whole_size).otherwise(F.col(c))
    return rows.withColumns({"x": begin("x", "right"), "y": begin("y", "bottom"), "width": size("width", "x", "right"), "height": size("height", "y", "bottom")})


def struct_type(name: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, T._parse_datatype_string(f.kind), not f.required) for f in SCHEMAS[name]])


def with_defaults(rows: DataFrame, name: str) -> DataFrame:
    """rows with every field of the schema: missing and null ones at their defaults."""
    filled = {}
    for f in SCHEMAS[name]:
        own = F.col(f.name).cast(f.kind) if f.name in rows.columns else F.lit(None).cast(f.kind)
        filled[f.name] = own if f.default is None else F.coalesce(own, F.lit(f.default).cast(f.kind))
    return rows.withColumns(filled)


def violations(rows: DataFrame, name: str, key: Sequence[str], closed: bool = False) -> DataFrame:
    """key and field of every value that breaks its rule; with `closed` also of columns that the schema
    hasn't, where they aren't null."""
    found = []
    for f in SCHEMAS[name]:
        if f.name in rows.columns:
            own = F.col(f.name).cast(f.kind)
            bad = F.when(own.isNull(), F.lit(f.required)).otherwise(~F.coalesce(f.rule(own), F.lit(False)))
            found.append(F.when(bad, f.name))
        elif f.required:
            found.append(F.lit(f.name))
    if closed:
        known = {f.name for f in SCHEMAS[name]} | set(key)
        found += [F.when(F.col(c).isNotNull(), c) for c in rows.columns if c not in known]
    return rows.select(*key, F.explode(F.array_compact(F.array(*found))).alias("field"))


def stop_violations(gradients: DataFrame, key: Sequence[str], stops: str = "stops") -> DataFrame:
    """key and rule of gradients whose stops are too few, out of order, out of range or of two units."""
    each = gradients.select(*key, F.col(stops).alias("s"))
    unit = lambda x: F.coalesce(x["unit"], F.lit("normalized"))
    offsets = F.transform("s", lambda x: x["offset"])
    steps = F.zip_with(F.slice(offsets, 1, F.greatest(F.lit(0), F.size("s") - 1)), F.slice(offsets, 2, F.greatest(F.lit(0), F.size("s") - 1)), lambda a, b: b >= a)
    rules = {
        "few": F.size("s") < 2,
        "units": F.size(F.array_distinct(F.transform("s", unit))) > 1,
        "range": F.exists("s", lambda x: (x["offset"] < 0) | ((unit(x) == "normalized") & (x["offset"] > 1))),
        "order": ~F.forall(steps, lambda ok: ok),
    }
    return each.select(*key, F.explode(F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules.items())))).alias("rule"))
