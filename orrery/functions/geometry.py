"""Points, fits and the gradients and shadows that some scenes compute."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .noise import boil
from .style import number
from .timeline import Number, col


def cover_fit(width: Column, height: Column, canvas_width: Column | Number, canvas_height: Column | Number) -> Column:
    """struct(scale, width, height) at which a picture just covers a canvas."""
    scale = F.greatest(F.try_divide(col(canvas_width), col(width)), F.try_divide(col(canvas_height), col(height)))
    return F.struct(scale.alias("scale"), (col(width) * scale).alias("width"), (col(height) * scale).alias("height"))


def polar(degrees: Column, radius: Column | Number, center: Column | Number = 0) -> Column:
    """struct(x, y) on a circle, 0 degrees being at the top."""
    turn = (col(degrees) - 90) * (math.pi / 180)
    return F.struct((col(center) + F.cos(turn) * col(radius)).alias("x"), (col(center) + F.sin(turn) * col(radius)).alias("y"))


def ray_path(index: Column, step: Number = 18, width: Number = 6, center: Number = 540, radius: Number = 1000) -> Column:
    """SVG path of a ray: from the center out to an arc of `width` degrees."""
    ends = [polar(index * float(step) + w, radius, center) for w in (0.0, float(width))]
    c, r = (number(F.lit(float(x))) for x in (center, radius))
    at = [F.concat_ws(" ", number(p["x"]), number(p["y"])) for p in ends]
    return F.concat_ws(" ", F.lit("M"), c, c, F.lit("L"), at[0], F.lit("A"), r, r, F.lit("0 0 1"), at[1], F.lit("Z"))


def rule_points(index: Column, bucket: Column) -> Column:
    """The points of a hand-drawn rule of a table. Numbers are fixed values."""
    at = lambda k: F.struct((110 + k * (860 / 16)).alias("x"), (680 + index * 250 + boil(40 + index * 9 + k * 4.7, bucket, 6, held=1)).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: at(k.cast("double")))


def polygon_problem(points: Column) -> Column:
    """Why array<struct<x, y>> is no polygon of the unit square: few, finite or outside; null if it is one."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    inside = lambda v: (v >= 0) & (v <= 1)
    return (
        F.when(F.coalesce(F.size(points), F.lit(0)) < 3, "few")
        .when(~F.forall(points, lambda p: finite(p["x"]) & finite(p["y"])), "finite")
        .when(~F.forall(points, lambda p: inside(p["x"]) & inside(p["y"])), "outside")
    )


def shadow(x: Column | Number, y: Column | Number, blur: Column | Number, color: str) -> Column:
    return F.struct(col(x).alias("x"), col(y).alias("y"), col(blur).alias("blur"), F.lit(color).alias("color"), F.lit(False).alias("inset"))


def stops(*values: tuple[float, Column | str]) -> Column:
    return F.array(*(F.struct(F.lit(float(at)).alias("offset"), (c if isinstance(c, Column) else F.lit(c)).alias("color"), F.lit("normalized").alias("unit")) for at, c in values))


def ghosts(amount: Column) -> Column:
    """The two colour ghosts of a glitch. Colours are fixed values."""
    return F.array(shadow(-amount, 0, 0, "rgba(255,0,0,0.75)"), shadow(amount, 0, 0, "rgba(0,200,255,0.75)"))


def mark_shadows(glow: Column, color: str = "#5D91FF") -> Column:
    """Three glows around a mark, each wider and fainter. Numbers are fixed values."""
    return F.array(shadow(0, 0, glow, color), shadow(0, 0, glow * 1.8, f"{color}88"), shadow(0, 0, glow * 3, f"{color}44"))


def atmosphere_stops() -> Column:
    """Stops of a conic gradient behind a stage. Fixed values."""
    return stops((0, "transparent"), (1 / 6, "#5D91FF0a"), (1 / 3, "transparent"), (5 / 9, "#5D91FF07"), (7 / 9, "transparent"), (1, "transparent"))


def flash_stops(opacity: Column) -> Column:
    """Stops of the radial flash of a snap. Fixed values."""
    return stops((0, F.concat(F.lit("rgba(93,145,255,"), number(opacity), F.lit(")"))), (0.6, "transparent"))
