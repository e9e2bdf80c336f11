"""Strings: reveals, counters, codes, identifiers and style text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .noise import number_key
from .timeline import clamp, round_half_up

#: Identifier patterns, whole strings only. Fixed values.
SHA256 = r"\A[a-f0-9]{64}\z"
COMMIT = r"\A(?:[a-f0-9]{40}|[a-f0-9]{64})\z"
SAFE_ID = r"\A[a-zA-Z0-9._-]{1,160}\z"
RECONCILIATION_KEY = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
#: Frames at which the first twelve words appear; later ones follow every three frames. Fixed values.
WORD_FRAMES = (0, 2, 3, 6, 7, 9, 13, 14, 18, 19, 23, 27)
WORD_TAIL, WORD_STEP = 30, 3
#: Characters typed at each step of a cycle, and the frame at which typing starts. Fixed values.
TYPING, TYPING_START = (2, 1, 1, 0, 3, 1, 2, 0), 10


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: supplementary characters count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_safe_id(text: Column) -> Column:
    return text.rlike(SAFE_ID)


def is_sha256(text: Column) -> Column:
    return text.rlike(SHA256)


def is_commit(text: Column) -> Column:
    return text.rlike(COMMIT)


def is_reconciliation_key(text: Column) -> Column:
    return text.rlike(RECONCILIATION_KEY)


def is_media_resource(text: Column) -> Column:
    """Opaque media names: not empty, and without control characters."""
    return (F.length(text) > 0) & ~text.rlike(r"[\x00-\x1f\x7f]")


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def reveal_words(text: Column, frame: Column, cadence: Sequence[int] = WORD_FRAMES, tail: int = WORD_TAIL, step: int = WORD_STEP) -> Column:
    """The words that have appeared by a frame, joined by blanks."""
    due = F.array(*(F.lit(c) for c in cadence))
    at = lambda i: F.when(i < len(cadence), F.get(due, i)).otherwise(tail + (i - len(cadence)) * step)
    return F.array_join(F.filter(words(text), lambda _, i: frame >= at(i)), " ")


def typed_count(frame: Column, length: Column, pattern: Sequence[int] = TYPING, start: int = TYPING_START) -> Column:
    """Characters typed by a frame, in uneven steps that repeat: whole cycles and a prefix sum."""
    steps = (F.floor(frame) - start + 1).cast("long")
    sums = F.array(*(F.lit(sum(pattern[:k])) for k in range(len(pattern))))
    count = F.floor(steps / len(pattern)) * sum(pattern) + F.get(sums, F.pmod(steps, F.lit(len(pattern))).cast("int"))
    return F.when(steps <= 0, 0).otherwise(F.least(length, count)).cast("int")


def typed_text(text: Column, frame: Column, **options) -> Column:
    return F.substring(text, F.lit(1), typed_count(frame, F.length(text), **options))


def visible_characters(elapsed: Column, length: Column, mode: str, amount: float, fps: Column | None = None) -> Column:
    """Typewriter: `duration` in frames for the whole, `second` or `frame` for a speed."""
    if mode == "duration":
        return F.floor(clamp(elapsed / amount) * length).cast("int")
    if mode == "second":
        return F.least(length, F.floor(F.greatest(F.lit(0.0), elapsed / fps) * amount)).cast("int")
    if mode == "frame":
        return F.least(length, F.floor(F.greatest(F.lit(0.0), elapsed) * amount)).cast("int")
    raise ValueError("mode is duration, second or frame")


def pad2(x: Column) -> Column:
    """Two digits or more of a number's whole part, without its sign."""
    digits = F.floor(F.abs(x)).cast("long").cast("string")
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def timecode(frame: Column, fps: Column) -> Column:
    """HH:MM:SS:FF; hours don't wrap."""
    safe = F.greatest(F.lit(1.0), fps)
    seconds = F.floor(frame / safe)
    return F.concat_ws(":", pad2(F.floor(seconds / 3600)), pad2(F.floor(seconds / 60) % 60), pad2(seconds % 60), pad2(frame % safe))


def score_text(base: Column, gain: Column, tick: Column) -> Column:
    return round_half_up(base + gain * tick).cast("long").cast("string")


def fitted_size(length: Column, alone: Column, wide: int = 980, narrow: int = 500, low: int = 56, high: int = 132) -> Column:
    """Type size at which a word fits: wide where it stands alone."""
    room = F.when(alone, float(wide)).otherwise(float(narrow))
    return clamp(round_half_up(F.coalesce(F.try_divide(room, length * 0.6), F.lit(float(high)))), low, high)


def path_text(segments: Column) -> Column:
    """SVG path data of array<struct<command, x, y, x1, y1, x2, y2>>."""

    def one(s: Column) -> Column:
        pair = lambda a, b: F.concat_ws(" ", number_key(s[a] + 0.0), number_key(s[b] + 0.0))
        return (
            F.when(s["command"].isin("M", "L"), F.concat_ws(" ", s["command"], pair("x", "y")))
            .when(s["command"] == "C", F.concat_ws(" ", s["command"], pair("x1", "y1"), pair("x2", "y2"), pair("x", "y")))
            .when(s["command"] == "Q", F.concat_ws(" ", s["command"], pair("x1", "y1"), pair("x", "y")))
            .otherwise(s["command"])
        )

    return F.array_join(F.transform(segments, one), " ")


def points_text(points: Column) -> Column:
    """`x,y x,y` of array<struct<x, y>>."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", number_key(p["x"] + 0.0), number_key(p["y"] + 0.0))), " ")


def css_string(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def characters(text: Column) -> Column:
    """The UTF-16 units of a text, each as text of its own; halves of a pair stay together with the next."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def to_fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, as text, halves away from zero on its decimal value."""
    return F.format_string(f"%.{digits}f", F.round(x.cast("decimal(38,18)"), digits).cast("double"))
