"""More laws by kind: terminals, signals, rapid cuts, zine pages, chalk. Numbers are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TYPING as TYPING_STEPS
from ..functions.timeline import Spring, round_half_up
from .catalogue import TEXT, Channels, law
from .terms import T, absolute, back_out, bezier, call, clamp, cos, cubic_out, duration, floor, fps, frame, greatest, joined, least, lerp, noise, pick, power, progress, rounded, sin, spring, term, through, when

#: Characters of the message.
LENGTH = call(lambda c: F.length(c).cast("double"), "length({})::DOUBLE", TEXT)
#: How each terminal recipe types: mode, rate (or seconds for the whole), first frame.
TYPING = {"pixel-crt": ("whole", 1.8, 0), "soft-speaker": ("second", 22, 4), "bevel-status": ("second", 28, 0), "tagged-status": ("frame", 1.7, 0), "press-start-crt": ("second", 18, 0), "steel-speaker": ("second", 28, 0)}
#: Cursor mode, unit of its period, and the period.
CURSORS = {"pixel-crt": ("after", "seconds", 0.35), "soft-speaker": ("after", "frames", 18), "bevel-status": ("hidden", "frames", 1), "tagged-status": ("before", "frames", 14), "press-start-crt": ("before", "frames", 8), "steel-speaker": ("before", "frames", 5)}
#: Indicator mode, unit of its period, the period, colours on and off, and its nudge.
INDICATORS = {
    "pixel-crt": ("pulse", "seconds", 0.15, "#aaccff", "#4466aa", 0), "soft-speaker": ("never", "frames", 1, "transparent", "transparent", 0), "bevel-status": ("conditional", "seconds", 0.4, "#a0c8ff", "#a0c8ff", 0),
    "tagged-status": ("alternate", "frames", 14, "#88aaff", "#4466cc", -3), "press-start-crt": ("reserved", "frames", 8, "#ffe080", "#ffe080", -2), "steel-speaker": ("reserved", "frames", 10, "#ffffff", "#ffffff", 0),
}
#: Base, phase and wave of the scan lines.
SCANLINES = {"pixel-crt": (0.04, 0.2, 0.01), "soft-speaker": (0, 0, 0), "bevel-status": (0, 0, 0), "tagged-status": (0, 0, 0), "press-start-crt": (0.10, 0, 0), "steel-speaker": (0.18, 0, 0)}


def typed(recipe: str, length: T = LENGTH) -> T:
    mode, rate, first = TYPING[recipe]
    if mode == "whole":
        return least(length, floor(length * clamp((frame - first) / greatest(1, rounded(fps * rate)))))
    since = greatest(0, frame - first)
    return least(length, floor((since if mode == "frame" else since / fps) * rate))


def prefix(text: T, count: T) -> T:
    return T(lambda: F.substring(text.col, F.lit(1), count.col.cast("int")), f"substr({text.sql}, 1, ({count.sql})::INT)")


def message(at: T) -> tuple[T, T]:
    """Characters of a message that are typed in uneven steps, and what it shows: these, and a cursor that
    blinks when all are there."""
    sums = [sum(TYPING_STEPS[:k]) for k in range(len(TYPING_STEPS))]
    steps, n = at + 1, len(TYPING_STEPS)
    count = when(steps <= 0, 0, least(LENGTH, floor(steps / n) * sum(TYPING_STEPS) + pick(sums, greatest(0, steps) % n)))
    cursor = when((at >= 0) & (as_number(count < LENGTH) + as_number((floor(at / 5) % 2).equals(0)) > 0), "▌", "")
    body = prefix(TEXT, count)
    return count, T(lambda: F.concat(body.col, cursor.col), f"({body.sql}) || ({cursor.sql})")


def blinking(unit: str, period: float) -> T:
    span = greatest(1, rounded(fps * period)) if unit == "seconds" else term(period)
    return (floor(frame / span) % 2).equals(0)


def as_number(condition: T) -> T:
    return when(condition, 1, 0)


def typing_recipes(spark: SparkSession) -> DataFrame:
    """recipe and typing (mode, rate, first): the recipes as a table, for tables that name theirs in a column."""
    return spark.createDataFrame([(k, (m, float(r), float(f))) for k, (m, r, f) in TYPING.items()], "recipe string, typing struct<mode: string, rate: double, first: double>")


def typed_by(typing: Column, at: Column, rate: Column, length: Column) -> Column:
    """Characters that a row's own recipe has typed by a frame: one expression for all recipes, `typing` as in
    typing_recipes, or a row's own. Null where the mode is none of the three."""
    mode, since = typing["mode"], F.greatest(F.lit(0.0), at - typing["first"])
    whole = F.floor(length * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - typing["first"]) / F.greatest(F.lit(1.0), round_half_up(rate * typing["rate"]).cast("double")))))
    count = F.when(mode == "whole", whole).when(mode == "second", F.floor(since / rate * typing["rate"])).when(mode == "frame", F.floor(since * typing["rate"]))
    return F.when(count.isNotNull(), F.least(length, count)).cast("int")


def with_typing(rows: DataFrame, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (recipe) with their recipe's typing, and the rows whose recipe isn't in the table. A table of recipes is
    authored, and small."""
    found = rows.join(F.broadcast(recipes), "recipe", "left")
    return found.filter("typing IS NOT NULL"), found.filter("typing IS NULL").drop("typing")


for _recipe in TYPING:

    @law(f"blue-terminal.text-cadence/{_recipe}")
    def _(recipe=_recipe) -> Channels:
        return {"visible": typed(recipe), "text": prefix(TEXT, typed(recipe))}

    @law(f"blue-terminal.cursor-cadence/{_recipe}")
    def _(recipe=_recipe) -> Channels:
        mode, unit, period = CURSORS[recipe]
        open_, blink = typed(recipe) < LENGTH, blinking(unit, period)
        if mode == "after":
            shown = when(open_, 1, as_number(blink))
            return {"present": shown, "opacity": shown}
        return {"present": as_number(open_), "opacity": term(0) if mode == "hidden" else as_number(open_ & blink)}

    @law(f"blue-terminal.indicator-cadence/{_recipe}")
    def _(recipe=_recipe) -> Channels:
        mode, unit, period, on, off, nudge = INDICATORS[recipe]
        done, blink = as_number(typed(recipe) >= LENGTH), as_number(blinking(unit, period))
        if mode == "never":
            return {"present": term(0), "opacity": term(0), "y": term(0), "color": term(off)}
        if mode in ("conditional", "reserved"):
            return {"present": done * blink if mode == "conditional" else done, "opacity": done * blink, "y": done * nudge, "color": term(on)}
        lit = blink if mode == "alternate" else as_number((sin(frame * 0.15) + 1) / 2 > 0.65)
        return {"present": done, "opacity": done, "lit": done * lit, "color": when(lit > 0, on, off), "y": done * blink * nudge if mode == "alternate" else term(0)}

    @law(f"blue-terminal.scanline-cadence/{_recipe}")
    def _(recipe=_recipe) -> Channels:
        base, phase, wave = SCANLINES[recipe]
        return {"opacity": base + sin(frame * phase) * wave}


@law("blue-terminal.panel-boot")
def _() -> Channels:
    enter, focus = back_out(progress(frame, 0, 18), 1.72), cubic_out(progress(frame, 0, 12))
    step = rounded(enter * 16) / 16
    flash = when((frame < 12) & (floor(frame) % 4).equals(0), 0.42, 0)
    shadow = when(frame < 10, "24px 28px 0 #4488ff", joined(rounded(lerp(24, 12, focus)), "px ", rounded(lerp(28, 16, focus)), "px 0 #001055"))
    return {"opacity": progress(frame, 0, 3), "rotate": lerp(-2.5, 0, step), "scale_x": lerp(0.78, 1, step), "scale_y": lerp(0.56, 1, step), "x": rounded(lerp(-24, 0, step)), "y": rounded(lerp(86, 0, step)), "brightness": lerp(1.32, 1, focus) + flash, "contrast": lerp(1.34, 1.12, focus), "shadow": shadow}


@law("blue-terminal.message-cadence")
def _() -> Channels:
    since, focus = floor(frame) - 10, cubic_out(progress(frame, 10, 14))
    count, shown = message(since)
    return {"visible": count, "text": shown, "opacity": progress(frame, 8, 3), "letter_spacing": lerp(1.6, 0, focus), "brightness": when((floor(since / 5) % 2).equals(0) & (since >= 0), 1.12, 1)}


@law("blue-terminal.panel-transit/pixel-crt")
def _() -> Channels:
    enter, last = spring(frame, Spring(20, 1, 120)), rounded(fps * 0.4)
    return {"opacity": enter * (1 - progress(frame, 154 - last, last)), "scale": lerp(0.85, 1, enter)}


@law("blue-terminal.panel-transit/soft-speaker")
def _() -> Channels:
    return {"opacity": progress(frame, 0, 8), "y": lerp(30, 0, cubic_out(progress(frame, 0, 10)))}


@law("blue-terminal.panel-transit/bevel-status")
def _() -> Channels:
    return {"opacity": progress(frame, 0, 6), "scale_y": lerp(0.1, 1, cubic_out(progress(frame, 0, 8)))}


@law("blue-terminal.panel-transit/tagged-status")
def _() -> Channels:
    return {"opacity": cubic_out(progress(frame, 0, 8)), "scale_y": lerp(0.05, 1, cubic_out(progress(frame, 0, 10)))}


law("blue-terminal.panel-transit/press-start-crt")(lambda: {"opacity": term(1), "scale": term(1)})
for _role in ("scene", "label", "body", "tail", "corner-top", "corner-bottom"):

    @law(f"blue-terminal.panel-transit/steel-{_role}")
    def _(role=_role) -> Channels:
        enter = cubic_out(progress(frame, 0, 12))
        seen, tall = when(enter < 0.4, enter / 0.4, 1), lerp(0.05, 1, enter)
        if role == "scene":
            return {"opacity": 1 - progress(frame, 345, 10), "scale_y": term(1), "y": term(0)}
        if role == "tail":
            return {"opacity": seen, "scale_y": term(1), "y": 220 * (tall - 1)}
        return {"opacity": seen * 0.8 if role.startswith("corner") else seen, "scale_y": tall, "y": term(0)}


def chance(seed: T) -> T:
    x = sin(seed * 127.1 + 311.7) * 43758.5453
    return x - floor(x)


law("crt-glitch.analog-scan-burst/film-field")(lambda: {"grain_seed": frame * 7919 + 104729})


@law("crt-glitch.analog-scan-burst/title")
def _() -> Channels:
    enter_ease, leave_ease, split_ease = bezier(0.16, 1, 0.3, 1), bezier(0.45, 0, 0.55, 1), bezier(0.34, 1.56, 0.64, 1)
    enter = rounded(fps * 0.4)
    last, every = greatest(enter, duration - enter), rounded(fps * 0.6)
    phase = floor(frame / every)
    broken = (chance(phase * 1000 + 42) > 0.5) & (frame % every < 4) & (frame > enter) & (frame < last)
    in_, out = least(1, frame / enter), greatest(0, (frame - last) / enter)
    entering, leaving = frame < enter, frame >= last
    seen = through(frame, (0, enter * 0.35, enter), (0, 0.65, 1), enter_ease)
    seen = when(chance(frame * 11 + 3) > 0.55, greatest(0.08, seen - (1 - in_) * 0.55), seen)
    gone = through(out, (0, 0.4, 1), (1, 0.55, 0), leave_ease)
    gone = when(chance(frame * 13 + 7) > 0.5, gone * when(chance(frame * 19 + 1) > 0.65, 0.15, 0.7), gone)
    shake = lambda a, b: chance(frame * a + b) - 0.5
    split_in = through(in_, (0, 0.35, 1), (16, 9, 0), enter_ease) + shake(3, 5) * 10 * (1 - in_)
    split_out = through(out, (0, 0.5, 1), (0, 10, 22), split_ease)
    return {
        "opacity": when(leaving, gone, when(entering, seen, 1)),
        "split": when(entering, split_in, when(broken, 8 + chance(phase * 2000 + 77) * 10, when(leaving, split_out, 0))),
        "shake_y": when(entering, shake(5, 1) * 6 * (1 - in_), when(broken, shake(17, 3) * 5, when(leaving, shake(11, 9) * 5 * out, 0))),
    }


#: Channel that moves, frames, scale from and to, offset from and to, curve.
CUTS = {
    "zoom-out": ("scale", 24, 1.3, 1, 0, 0, (0.16, 1, 0.3, 1)), "zoom-in": ("scale", 36, 1, 1.12, 0, 0, None), "snap-zoom": ("scale", 42, 1.25, 1, 0, 0, (0.16, 1, 0.3, 1)),
    "lateral-pan": ("x", 30, 1.1, 1.1, -20, 20, (0.45, 0, 0.55, 1)), "ease-in-zoom": ("scale", 42, 1, 1.15, 0, 0, (0.42, 0, 1, 1)), "vertical-drift": ("y", 36, 1.15, 1.15, 30, -30, None),
}
for _recipe, _cut in CUTS.items():

    @law(f"rapid-photo.cut/{_recipe}")
    def _(cut=_cut) -> Channels:
        moves, frames, scale_a, scale_b, from_, to, curve = cut
        amount = progress(frame, 0, frames)
        amount = bezier(*curve)(amount) if curve else amount
        return {"scale": lerp(scale_a, scale_b, amount)} | ({} if moves == "scale" else {moves: lerp(from_, to, amount)})


@law("chalkboard.stroke-draw")
def _() -> Channels:
    hand = lambda seed: noise(seed, frame, 1.0)
    gone = 1 - cubic_out(progress(frame, 46, 14))
    return {
        "draw_end": cubic_out(progress(frame, 0, 36)), "stroke_width": 7 + hand(1) * 1.6, "content_opacity": cubic_out(progress(frame, 14, 22)),
        "dust_opacity": (0.65 + absolute(hand(2)) * 0.3) * progress(frame, 2, 38) * gone, "eraser_opacity": lerp(0, 0.48, cubic_out(progress(frame, 52, 12))) * (1 - progress(frame, 65, 7)),
    }


# fight-zine pages
def cubed(x: T) -> T:
    return power(x, 3)


def page_exit(seconds: float, scale: float | None = None) -> Channels:
    start = duration - rounded(fps * seconds)
    out = {"opacity": through(frame, (start, duration - 1), (1, 0), cubed)}
    return out if scale is None else out | {"scale": through(frame, (start, duration - 1), (1, scale))}


def fade_in(frames: float) -> T:
    return clamp(frame / frames)


def held_noise(seed: float, amplitude: float) -> T:
    return noise(seed, floor(frame / 2), amplitude)


def still_noise(seed: float, amplitude: float) -> T:
    return noise(seed, 0, amplitude)


law("fight-zine.title-cadence/stage")(lambda: page_exit(0.5, 1.12))
law("fight-zine.title-cadence/grid")(lambda: {"opacity": 0.05 * fade_in(8)})
law("fight-zine.title-cadence/border-stage")(lambda: {"opacity": fade_in(8), "x": held_noise(1.1, 4), "y": held_noise(2.2, 4)})
law("fight-zine.title-cadence/content")(lambda: {"x": held_noise(1.1, 4) * 0.6, "y": held_noise(2.2, 4) * 0.6})
#: Delay and turn of the title's words.
TITLE_WORDS = ((4, -2), (12, 1.5), (22, -1))
for _k, _word in enumerate(TITLE_WORDS):

    @law(f"fight-zine.title-cadence/word-{_k}")
    def _(k=_k, word=_word) -> Channels:
        amount = spring(frame - word[0], Spring(13, 0.8, 150))
        held = clamp(amount)
        return {"opacity": amount, "scale": lerp(0.4, 1, held), "y": lerp(70, 0, held), "rotate": word[1] + held_noise(20 + k * 5, 1.4), "shadow_x": 2 + held_noise(30 + k, 1), "shadow_y": 2 + held_noise(31 + k, 1)}


law("fight-zine.chart-cadence/stage")(lambda: page_exit(0.5, 1.06))
law("fight-zine.chart-cadence/grid")(lambda: {"opacity": 0.06 * fade_in(10)})
law("fight-zine.chart-cadence/plot")(lambda: {"opacity": fade_in(10), "x": sin(frame * 0.5) * 1.2, "y": cos(frame * 0.43) * 1.2})
law("fight-zine.chart-cadence/subtitle")(lambda: {"opacity": through(frame, (8, 22), (0, 0.8))})


@law("fight-zine.chart-cadence/title")
def _() -> Channels:
    amount = spring(frame - 4, Spring(16, 1, 110))
    return {"opacity": amount, "rotate": still_noise(99, 1.5), "y": lerp(-40, 0, clamp(amount))}


balanced = bezier(0.45, 0, 0.55, 1)
#: First frame of a trace, its callout's delay, turn and seed.
SIDES = {"rising": (12, 74, -6, 7), "falling": (20, 82, 5, 8)}
for _side, (_first, _delay, _turn, _seed) in SIDES.items():
    law(f"fight-zine.chart-cadence/{_side}-endpoint")(lambda a=_first: {"opacity": when(through(frame, (a, a + 58), (0, 1), balanced) > 0.98, 1, 0)})
    law(f"fight-zine.marker-scrawl-trace/chart-{_side}")(lambda a=_first: {"trace": through(frame, (a, a + 58), (0, 1), balanced)})

    @law(f"fight-zine.chart-cadence/{_side}-callout")
    def _(delay=_delay, turn=_turn, seed=_seed) -> Channels:
        amount = spring(frame - delay, Spring(12, 0.7, 140))
        return {"opacity": amount, "scale": amount, "rotate": turn + still_noise(seed, 2)}


law("fight-zine.chart-cadence/doodle")(lambda: {"opacity": spring(frame - 74, Spring(12, 0.7, 140))})
law("fight-zine.marker-scrawl-trace/chart-axis")(lambda: {"trace": through(frame, (0, 16), (0, 1))})
law("fight-zine.marker-scrawl-trace/title-border")(lambda: {"trace": through(frame, (2, 28), (0, 1)), "bucket": floor(frame / 2)})
law("fight-zine.marker-scrawl-trace/title-underline")(lambda: {"trace": through(frame, (30, 48), (0, 1)), "bucket": floor(frame / 2)})
law("fight-zine.marker-scrawl-trace/title-underline-echo")(lambda: {"trace": through(frame, (34, 52), (0, 1)), "bucket": floor(frame / 2)})
for _k in range(3):
    law(f"fight-zine.marker-scrawl-trace/table-rule-{_k}")(lambda k=_k: {"trace": through(frame, (4 + k * 3, 16 + k * 3), (0, 1)), "bucket": floor(frame / 2)})

law("fight-zine.ranking-table-cadence/stage")(lambda: page_exit(0.4))
law("fight-zine.ranking-table-cadence/grid")(lambda: {"opacity": 0.05 * fade_in(8)})
law("fight-zine.ranking-table-cadence/rule-stage")(lambda: {"opacity": fade_in(8), "x": held_noise(1.1, 3.5), "y": held_noise(2.2, 3.5)})
law("fight-zine.ranking-table-cadence/rows-stage")(lambda: {"x": held_noise(1.1, 3.5) * 0.6, "y": held_noise(2.2, 3.5) * 0.6})
law("fight-zine.ranking-table-cadence/title")(lambda: {"opacity": fade_in(8), "rotate": held_noise(99, 1)})
law("fight-zine.ranking-table-cadence/subtitle")(lambda: {"opacity": fade_in(8) * 0.8})
#: Frames at which the scores of the rows begin to count.
TICKS = (18, 26, 34, 42, 50)
for _k, _at in enumerate(TICKS):

    @law(f"fight-zine.ranking-table-cadence/row-{_k}")
    def _(k=_k) -> Channels:
        amount = spring(frame - (4 + k * 3), Spring(18, 1, 130))
        return {"opacity": amount, "x": lerp(-120, 0, amount)}

    law(f"fight-zine.ranking-table-cadence/row-rank-{_k}")(lambda k=_k: {"rotate": held_noise(80 + k, 2)})

    @law(f"fight-zine.ranking-table-cadence/score-{_k}")
    def _(k=_k, at=_at) -> Channels:
        tick = through(frame, (at, at + 10), (0, 1), cubic_out)
        return {"score": rounded(100 + k + (4 + k) * tick), "scale": 1 + through(frame, (at, at + 4, at + 12), (0, 0.22, 0)), "rotate": held_noise(70 + k * 5, 1.2)}

    @law(f"fight-zine.ranking-table-cadence/badge-{_k}")
    def _(k=_k, at=_at) -> Channels:
        amount = spring(frame - at, Spring(10, 0.7, 170))
        return {"opacity": amount, "scale": amount, "rotate": -8 + held_noise(90 + k, 2)}


#: Of each recipe: seconds that images fade, frames and levels of their colour, scale from and to, sideways drift.
PLATES = {
    "lateral-push": (0.35, 14, 0.2, 1.05, 1.18, 1.34, 24), "foreground-drift": (0.35, 14, 0.2, 1.05, 1.16, 1.24, -50), "shutter-shake": (0.22, 12, 0.15, 1.12, 1.42, 1.2, 0),
    "paparazzi-burst": (0.18, 14, 0.2, 1.05, 1.16, 1.28, 0), "gold-finale": (0.45, 18, 0.2, 1.08, 1.12, 1.25, 0),
}
#: Of each recipe: delays of rank, label and nameplate, the rank's spring, its first scale and turn.
RANKS = {
    "lateral-push": (8, 16, 22, Spring(9, 0.8, 170), 2.4, -14), "foreground-drift": (8, 16, 22, Spring(9, 0.8, 170), 2.4, -14), "shutter-shake": (6, 14, 20, Spring(8, 0.8, 190), 2.6, -16),
    "paparazzi-burst": (8, 16, 22, Spring(9, 0.8, 175), 2.4, -14), "gold-finale": (10, 20, 38, Spring(12, 0.9, 130), 2.2, None),
}
for _recipe in PLATES:

    @law(f"fight-zine.media-rank-cadence/{_recipe}-stage")
    def _(recipe=_recipe) -> Channels:
        return page_exit(0.5 if recipe == "gold-finale" else 0.45)

    for _k in range(3):

        @law(f"fight-zine.media-rank-cadence/{_recipe}-image-{_k}")
        def _(recipe=_recipe, k=_k) -> Channels:
            seconds, coloured, low, high, scale_a, scale_b, sway = PLATES[recipe]
            third, fade = duration / 3, rounded(fps * seconds)
            local = frame - k * third
            share = local / third
            seen = least(1 if k == 0 else clamp(local / fade), 1 if k == 2 else clamp((third - local) / fade))
            scale = lerp(scale_a, scale_b, greatest(0, share))
            if recipe == "shutter-shake":
                scale = scale + share * 0.1
            side = -sway if k % 2 == 0 else sway
            return {"opacity": seen, "saturate": through(frame, (0, coloured), (low, high)), "scale": scale, "x": lerp(side, -side, share) if sway else term(0)}

    @law(f"fight-zine.media-rank-cadence/{_recipe}-rank")
    def _(recipe=_recipe) -> Channels:
        delay, _, _, own, large, turn = RANKS[recipe]
        amount = spring(frame - delay, own)
        if turn is None:
            return {"stage_opacity": amount, "scale": lerp(large, 1, amount), "glow": lerp(20, 55, (sin(frame * 0.08) + 1) / 2)}
        return {"opacity": amount, "scale": lerp(large, 1, amount), "rotate": lerp(turn, -6, amount)}

    @law(f"fight-zine.media-rank-cadence/{_recipe}-label")
    def _(recipe=_recipe) -> Channels:
        amount = spring(frame - RANKS[recipe][1], Spring(18, 1, 120))
        return {"opacity": amount, "x": lerp(-500, 0, amount), "rule_scale": amount}

    @law(f"fight-zine.media-rank-cadence/{_recipe}-nameplate")
    def _(recipe=_recipe) -> Channels:
        amount = spring(frame - RANKS[recipe][2], Spring(20, 1, 110))
        return {"opacity": amount, "y": lerp(80, 0, amount)}


law("fight-zine.media-rank-cadence/foreground")(lambda: {"x": lerp(18, -18, frame / duration)})
law("fight-zine.media-rank-cadence/gold-rays")(lambda: {"opacity": fade_in(30) * (0.18 + sin(frame * 0.06) * 0.05), "rotation": frame * 0.25})
law("fight-zine.media-rank-cadence/gold-glow")(lambda: {"opacity": fade_in(30)})


@law("fight-zine.media-rank-cadence/crown")
def _() -> Channels:
    amount = spring(frame - 30, Spring(14, 1, 120))
    return {"opacity": amount, "offset_y": lerp(-260, 0, amount)}


for _k in range(3):

    @law(f"fight-zine.media-rank-cadence/particle-{_k}")
    def _(k=_k) -> Channels:
        seed = term(k * 37.7)
        speed = 0.4 + (sin(seed * 2.1) * 0.5 + 0.5) * 0.8
        return {"y": 1920 - (frame * speed * 6 + k * 140) % 2100, "opacity": (0.3 + (sin(frame * 0.1 + seed) * 0.5 + 0.5) * 0.7) * fade_in(30)}
