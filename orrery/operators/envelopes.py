"""Aggregations over impacts: peaks, shakes and impulses of fixed lists of moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.timeline import clamp, interpolate, milliseconds_to_frames

#: Moments of five hits in milliseconds, the phases and speeds of their shake. Fixed values.
HITS = (0, 150, 300, 450, 600)
SHAKE_MS, SHAKE = 100, 34
FLASH_MS, FLASH = 80, 0.9


def flash(elapsed: Column, length: float = FLASH_MS, peak: float = FLASH) -> Column:
    active = F.when((elapsed >= 0) & (elapsed < length), 1.0).otherwise(0.0)
    return active * peak * (1 - clamp(elapsed / length))


def exposure(time: Column, points: Column, length: float = FLASH_MS, peak: float = FLASH) -> Column:
    """The largest flash at a time, over an array of points; 0 without one."""
    return F.aggregate(points, F.lit(0.0), lambda most, p: F.greatest(most, flash(time - p, length, peak)))


def shake(frame: Column, fps: Column | float, hits: Sequence[float] = HITS) -> Column:
    """(x, y, rotate): the sum of what each hit of the last 100 ms still moves."""
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    window = milliseconds_to_frames(F.lit(float(SHAKE_MS)), fps)
    moments = F.transform(F.array(*(F.lit(float(h)) for h in hits)), lambda h: frame - milliseconds_to_frames(h, fps))

    def total(part) -> Column:
        parts = F.transform(moments, lambda e, i: F.when((e >= 0) & (e < window), part(e, i, 1 - F.try_divide(e, window))).otherwise(0.0))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    return F.struct(
        total(lambda e, i, left: F.sin((e + i * 13) * 5.7) * (SHAKE * left)).alias("x"),
        total(lambda e, i, left: F.cos((e + i * 7) * 6.3) * (SHAKE * left)).alias("y"),
        total(lambda e, i, left: F.sin((e + i * 5) * 7.1) * 1.4 * left).alias("rotate"),
    )


def burst(frame: Column, fps: Column | float, hits: Sequence[float] = HITS) -> Column:
    """The brightest of the hits' exposures."""
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    values = []
    for h in hits:
        elapsed = frame - milliseconds_to_frames(F.lit(float(h)), fps)
        values.append(F.when(elapsed < 0, 0.0).otherwise(interpolate(elapsed, (0, 1, 5), (0.85, 0.9, 0), "clamp", "clamp")))
    return F.greatest(F.lit(0.0), *values)


def impulses(frame: Column, base: Column, impulses_at: Sequence[tuple[float, float, float]]) -> Column:
    """base and triangular impulses (centre, half width, height), one at most."""
    out = base
    for centre, half, height in impulses_at:
        out = out + F.greatest(F.lit(0.0), 1 - F.abs(frame - centre) / half) * height
    return F.least(F.lit(1.0), out)
