"""The laws by kind: channels of a record at a frame. Numbers are fixed values.

Channels are flat: x, y, rotate, scale_x and so on. Laws that add to what a record already has give
what they add. A law that has roles or variants has an entry for each, `kind/role`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_FRAMES, WORD_STEP, WORD_TAIL, reveal_words
from ..functions.timeline import Spring
from .terms import PI, T, absolute, argument, back_out, bezier, clamp, cos, cubic_out, duration, ease_out, exp, fixed, floor, fps, frame, greatest, joined, least, lerp, ms, noise, pick, power, progress, rounded, sin, smooth, spring, term, through, when

Channels = dict[str, T]
#: What a unit with text shows.
TEXT = argument("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGH")
LAWS: dict[str, Callable[[], Channels]] = {}


def law(kind: str) -> Callable[[Callable[[], Channels]], Callable[[], Channels]]:
    def keep(f: Callable[[], Channels]) -> Callable[[], Channels]:
        LAWS[kind] = f
        return f

    return keep


def unknown(attached: DataFrame) -> DataFrame:
    """The rows (law) whose law isn't one of these: a violation each."""
    return attached.filter(~F.coalesce(F.col("law").isin(sorted(LAWS)), F.lit(False)))


def family(name: str) -> dict[str, Callable[[], Channels]]:
    return {k: f for k, f in LAWS.items() if k.startswith(f"{name}.")}


# archival-dossier
@law("archival-dossier.casefile-shutter-fall")
def _() -> Channels:
    fall, leave = back_out(progress(frame, 0, 15), 1.35), progress(frame, 22, 8)
    return {"opacity": least(progress(frame, 0, 2), 1 - leave), "rotate": lerp(-1.8, 0.35, fall), "scale_x": lerp(1.04, 1, fall), "scale_y": lerp(0.76, 1, fall), "x": lerp(-18, 0, fall), "y": lerp(-1260, 0, fall) + lerp(0, 1180, leave), "blur": greatest(0, lerp(16, 0, fall) + lerp(0, 8, leave))}


@law("archival-dossier.pinned-evidence-drop")
def _() -> Channels:
    fall = smooth(progress(frame, 0, 10))
    swing = when(frame < 16, lerp(2.4, -0.9, smooth(progress(frame, 10, 6))), lerp(-0.9, -0.25, smooth(progress(frame, 16, 8))))
    shadow = joined(rounded(lerp(30, 18, fall)), "px ", rounded(lerp(38, 24, fall)), "px 0 rgba(38,31,25,.42)")
    return {"opacity": progress(frame, 0, 3), "rotate": when(frame < 10, lerp(-8.5, 2.4, fall), swing), "scale_x": lerp(1.08, 1, fall), "scale_y": lerp(0.9, 1, fall), "x": lerp(-26, 0, fall), "y": lerp(-310, 0, fall), "blur": lerp(9, 0, fall), "brightness": lerp(1.18, 0.96, fall), "shadow": shadow}


@law("archival-dossier.scene-reveal")
def _() -> Channels:
    seen = smooth(progress(frame, 13, 7))
    return {"opacity": seen, "scale_x": lerp(1.025, 1, seen), "y": lerp(18, 0, seen), "blur": lerp(5, 0, seen), "brightness": lerp(0.72, 1, seen), "contrast": lerp(1.28, 1.06, seen), "saturate": lerp(0.35, 0.82, seen)}


@law("archival-dossier.carbon-copy-cadence")
def _() -> Channels:
    ink = progress(frame, 0, 8)
    due = ", ".join(map(str, WORD_FRAMES))
    sql = f"array_to_string(list_filter(list_filter(regexp_split_to_array({TEXT.sql}, '\\s+'), lambda w: w <> ''), lambda w, i: frame >= coalesce([{due}][i], {WORD_TAIL} + (i - 1 - {len(WORD_FRAMES)}) * {WORD_STEP})), ' ')"
    shown = T(lambda: reveal_words(TEXT.col, frame.col), sql)
    return {"opacity": progress(frame, 0, 2), "letter_spacing": lerp(2.8, 0.7, ink), "blur": lerp(1.6, 0, ink), "text": shown}


# retro-ritual
@law("retro-ritual.bone-idle-hop")
def _() -> Channels:
    phase = floor(frame / 2) % 12 / 12
    hop = greatest(0, sin(phase * PI))
    squash = when(hop.equals(0), 0.025, 0)
    return {"add_rotate": rounded(sin(phase * PI * 2) * 1.5), "times_scale_x": 1 + squash, "times_scale_y": 1 - squash, "add_y": rounded(hop * -12)}


@law("retro-ritual.portal-scene-reveal")
def _() -> Channels:
    step = floor(progress(frame, 15, 6) * 4) / 4
    return {"opacity": step, "scale_x": 1 + (1 - step) * 0.06, "x": when(step < 0.5, 12, 0), "y": when(step < 0.75, -8, 0), "brightness": when(step < 1, 1.55, 1), "contrast": 1.28 - step * 0.08, "saturate": 1.4 - step * 0.25}


@law("retro-ritual.portal-tile-stutter")
def _() -> Channels:
    step, leave = least(4, floor(progress(frame, 0, 16) * 5)), progress(frame, 20, 8)
    held = lambda *v: pick(v, step)
    blink = when((frame % 3).equals(1) & (frame < 14), 0.58, 1)
    return {
        "opacity": blink * (1 - leave), "rotate": held(-8, 5, -3, 1, 0) + leave * 3, "scale_x": held(0.08, 0.42, 0.36, 0.78, 1) + leave * 0.14, "scale_y": held(0.12, 0.36, 0.48, 0.82, 1) + leave * 0.14,
        "x": held(80, -32, 18, -6, 0) + leave * 36, "y": held(-48, 24, -12, 4, 0) - leave * 24, "brightness": held(2.2, 1.15, 1.8, 1.1, 1) + leave * 0.8, "shadow": when((step % 2).equals(0), "16px 0 0 #78d64b", "-16px 0 0 #8d5bd1"),
    }


@law("retro-ritual.ritual-card-deal")
def _() -> Channels:
    step = rounded(back_out(progress(frame, 0, 16), 1.75) * 12) / 12
    notch = lambda a, b, n: rounded(lerp(a, b, step) * n) / n
    edge = rounded(lerp(28, 14, step))
    return {"opacity": when(frame < 2, 0, 1), "rotate": notch(-9, 0, 2), "scale_x": notch(0.62, 1, 16), "scale_y": notch(1.22, 1, 16), "x": notch(520, 0, 1), "y": notch(96, 0, 1), "brightness": when((frame % 4).equals(0) & (frame < 16), 1.45, 1), "shadow": joined(edge, "px ", edge, "px 0 #5d3aa8")}


@law("retro-ritual.rune-trace")
def _() -> Channels:
    step, beat = floor(progress(frame, 2, 18) * 10) / 10, (frame % 4).equals(0)
    return {"draw_end": step, "opacity": when(frame < 2, 0, when(beat, 0.72, 1)), "stroke_width": when(beat, 8, 6), "rotate": when(frame < 12, -2, 0), "scale_x": when(step < 0.5, 0.96, 1), "scale_y": when(step < 0.5, 1.04, 1)}


# signal-editorial
@law("signal-editorial.impact-settle")
def _() -> Channels:
    enter, recoil = cubic_out(progress(frame, 0, 14)), back_out(progress(frame, 0, 20), 2.2)
    return {"opacity": progress(frame, 0, 4), "rotate": lerp(-5.5, 0, recoil), "scale_x": lerp(1.28, 1, recoil), "scale_y": lerp(0.82, 1, recoil), "skew_x": lerp(-8, 0, enter), "x": lerp(-148, 0, enter), "y": lerp(92, 0, recoil), "blur": lerp(14, 0, enter), "brightness": lerp(1.55, 1, enter), "contrast": lerp(1.35, 1, recoil), "shadow": joined(rounded(lerp(32, 18, recoil)), "px ", rounded(lerp(34, 20, recoil)), "px 0 #ff3b30")}


@law("signal-editorial.ink-rule-strike")
def _() -> Channels:
    drawn = cubic_out(progress(frame, 5, 12))
    return {"draw_end": drawn, "opacity": progress(frame, 5, 3), "stroke_width": lerp(18, 11, drawn), "rotate": lerp(-5, -1.5, drawn), "scale_x": lerp(0.82, 1, drawn), "y": lerp(18, 0, drawn)}


@law("signal-editorial.razor-cut-sweep")
def _() -> Channels:
    enter, leave = cubic_out(progress(frame, 0, 9)), smooth(progress(frame, 14, 8))
    return {"opacity": least(progress(frame, 0, 2), 1 - progress(frame, 19, 3)), "rotate": lerp(-11, -6, enter), "scale_x": lerp(0.72, 1.08, enter), "scale_y": lerp(1.35, 1, enter), "x": lerp(-1320, 1240, leave) + lerp(0, 1320, enter), "y": lerp(180, -40, enter), "blur": lerp(24, 0, enter) + lerp(0, 10, leave), "brightness": lerp(1.9, 1.08, enter)}


@law("signal-editorial.scene-reveal")
def _() -> Channels:
    seen = cubic_out(progress(frame, 8, 6))
    return {"opacity": seen, "scale_x": lerp(1.04, 1, seen), "x": lerp(34, 0, seen), "blur": lerp(8, 0, seen), "brightness": lerp(1.85, 1, seen), "contrast": lerp(1.32, 1, seen), "saturate": lerp(0.55, 1, seen)}


# media-montage: frames of the entrance and of a cut, scales at its ends, and a strobe's sources and milliseconds
ENTRANCE, CUT, SCALE_FROM, SCALE_TO = argument("entrance", 36), argument("cut_frames", 20), argument("scale_from", 1.2), argument("scale_to", 1)
SOURCES, STROBE = argument("sources", 3), argument("strobe_ms", 125)
quad_out = ease_out(lambda v: v * v)


@law("media-montage.black-stutter-reveal")
def _() -> Channels:
    shade = lerp(1, 0, bezier(0.42, 0, 0.58, 1)(progress(frame, 0, ENTRANCE)))
    for at in (0.24, 0.44, 0.64):
        shade = shade + greatest(0, (1.6 - absolute(frame - ENTRANCE * at)) / 1.6) * 0.55
    shade = least(1, shade)
    return {"opacity": when(shade > 0.001, shade, 0)}


@law("media-montage.cut-flash-envelope")
def _() -> Channels:
    return {"opacity": lerp(0.35, 0, progress(frame, 0, 3))}


@law("media-montage.first-clip-grade-reveal")
def _() -> Channels:
    even = progress(frame, 0, ENTRANCE)
    return {"saturate": lerp(0.35, 1, quad_out(even)), "contrast": lerp(1.55, 1, quad_out(even)), "brightness": lerp(0.55, 1, bezier(0.4, 0, 0.6, 1)(even))}


MOTIONS: dict[str, Callable[[], T]] = {
    "hard": lambda: when(frame.equals(0), 0, 1),
    "in": lambda: bezier(0.42, 0, 1, 1)(progress(frame, 0, CUT)),
    "out": lambda: bezier(0, 0, 0.58, 1)(progress(frame, 0, CUT)),
    "bounce": lambda: clamp(spring(frame, Spring(10, 0.6, 200))),
}
for _mode, _amount in MOTIONS.items():
    law(f"media-montage.flash-cut-motion/{_mode}")(lambda a=_amount: {"scale": lerp(SCALE_FROM, SCALE_TO, a())})


@law("media-montage.image-strobe-cuts")
def _() -> Channels:
    return {"index": floor(frame / greatest(1, ms(STROBE))) % SOURCES}


@law("media-montage.vignette-release")
def _() -> Channels:
    open_ = quad_out(progress(frame, 0, ENTRANCE))
    edge = lerp(0.92, 0, open_)
    return {"opacity": when(edge > 0.001, 1, 0), "inner": lerp(0.06, 0.62, open_), "edge_opacity": edge}


# micro-flash
for _last in (6, 7):

    @law(f"micro-flash.pulse/{_last}")
    def _(last=_last) -> Channels:
        t = progress(frame, 0, last)
        return {"opacity": when(t <= 0.3, t / 0.3, (1 - t) / 0.7)}


# neon-heart-pop
landing = bezier(0.16, 1, 0.3, 1)
HEART = Spring(12, 1, 100)


@law("neon-heart-pop.chroma-pop-settle")
def _() -> Channels:
    pop, settle, land = cubic_out(progress(frame, 0, 10)), smooth(progress(frame, 10, 8)), smooth(progress(frame, 0, 18))
    idle = greatest(0, frame - 18)
    held, pulse, on = sin(floor(idle / 2) * 1.7), sin(idle * 0.24), idle > 0
    return {
        "opacity": progress(frame, 0, 3), "rotate": when(on, held * 0.32, lerp(-1.4, 0, land)), "scale": when(frame < 10, lerp(0, 1.08, pop), lerp(1.08, 1, settle)) + when(on, pulse * 0.008, 0),
        "x": when(on, held * 1.5, 0), "y": lerp(34, 0, pop) + when(on, pulse * 2, 0), "blur": lerp(3, 0, progress(frame, 0, 8)), "brightness": lerp(1.42, 1, land), "contrast": lerp(1.24, 1.08, land), "saturate": lerp(1.62, 1.12, land),
        "shadow": when(frame < 5, "-3px 0 0 #31e7ff", when(frame < 10, "3px 0 0 #ff304f", "0 0 20px rgba(255,45,166,.58)")),
    }


@law("neon-heart-pop.chroma-stack-pop")
def _() -> Channels:
    whole = ms(300)
    return {"scale": through(frame, (0, whole * 0.6, whole), (0, 1.08, 1), cubic_out)}


for _line, _from in ((1, -500.0), (2, 500.0)):

    @law(f"neon-heart-pop.dual-line-glitch-cadence/line-{_line}")
    def _(line=_line, origin=_from) -> Channels:
        start = term(0) if line == 1 else ms(80)
        return {"x": through(frame, (start, start + ms(200)), (origin, 0), landing) + (sin(frame * 2.3) * 4 if line == 1 else 0), "rotate": term(0 if line == 1 else -4)}


@law("neon-heart-pop.dual-line-glitch-cadence/rule")
def _() -> Channels:
    return {"opacity": through(frame, (ms(250), ms(250) + ms(150)), (0, 1))}


@law("neon-heart-pop.flip-title-reveal")
def _() -> Channels:
    whole = fps * 0.25
    amount = least(frame / whole, 1)
    return {"rotate_x": lerp(90, 0, landing(clamp(amount))) + when(frame > whole, sin((frame - whole) / fps * PI * 0.5) * 3, 0), "translate_z": lerp(-300, 0, landing(clamp(amount)))}


CARDS = ((-1000, -1000, -12, 1), (1000, 1000, 8, 1), (0, -1200, -5, 1), (1200, 0, 15, 1), (0, 0, 0, 4))
HITS = (0, 150, 300, 450, 600)
for _k, _card in enumerate(CARDS):

    @law(f"neon-heart-pop.five-hit-photo-slam/{_k}")
    def _(k=_k, card=_card) -> Channels:
        local = frame - ms(HITS[k])
        amount = through(local, (0, ms(150)), (0, 1), landing)
        x, y, turn, scale = card
        return {"present": when(local >= 0, 1, 0), "x": lerp(x, 0, clamp(amount)), "y": lerp(y, 0, clamp(amount)), "rotate": lerp(turn * 1.6, turn, clamp(amount)), "scale": lerp(scale, 1, clamp(amount))}


@law("neon-heart-pop.five-hit-title-slam")
def _() -> Channels:
    local = frame - ms(750)
    there = when(local >= 0, 1, 0)
    return {"present": there, "opacity": there, "scale": through(local, (0, ms(80)), (3, 1), landing)}


@law("neon-heart-pop.five-hit-exposure-burst")
def _() -> Channels:
    glow = term(0)
    for h in HITS:
        since = frame - ms(h)
        glow = greatest(glow, when(since < 0, 0, through(since, (0, 1, 5), (0.85, 0.9, 0))))
    return {"opacity": glow, "present": when(glow > 0, 1, 0)}


@law("neon-heart-pop.five-hit-camera-shake")
def _() -> Channels:
    out = {"x": term(0), "y": term(0), "rotate": term(0)}
    for k, h in enumerate(HITS):
        since = frame - ms(h)
        left = when((since >= 0) & (since < ms(100)), 1 - since / ms(100), 0)
        out = {"x": out["x"] + sin((since + k * 13) * 5.7) * 34 * left, "y": out["y"] + cos((since + k * 7) * 6.3) * 34 * left, "rotate": out["rotate"] + sin((since + k * 5) * 7.1) * 1.4 * left}
    return out


@law("neon-heart-pop.heart-constellation-twinkle")
def _() -> Channels:
    return {"opacity": lerp(0.2, 1, clamp((sin((frame + 7) / fps * PI * 2) + 1) / 2))}


@law("neon-heart-pop.orbit-caption-reveal")
def _() -> Channels:
    return {"opacity": when(frame / fps * 1000 >= 350, through(frame, (ms(350), ms(550)), (0, 1)), 0)}


@law("neon-heart-pop.orbit-heart-burst")
def _() -> Channels:
    return {"rotate_y": frame / fps * 360, "scale": spring(frame, HEART, frames=12)}


@law("neon-heart-pop.orbit-particle-cadence")
def _() -> Channels:
    angle = frame / fps * 4 * PI + PI / 2
    return {"x": cos(angle) * 140, "y": sin(angle) * 140, "opacity": spring(frame, HEART, frames=12)}


@law("neon-heart-pop.spinning-heart-burst")
def _() -> Channels:
    return {"rotate_y": frame / fps * 360, "scale": spring(frame, HEART, frames=9)}


soft_out = ease_out(bezier(0.42, 0, 1, 1))


@law("neon-heart-pop.split-nameplate-cadence/primary-stage")
def _() -> Channels:
    return {"y": through(frame, (0, ms(300)), (-150, 0), soft_out)}


@law("neon-heart-pop.split-nameplate-cadence/accent-stage")
def _() -> Channels:
    return {"y": through(frame, (ms(100), ms(400)), (150, 0), soft_out), "rotate": term(-8)}


@law("neon-heart-pop.split-nameplate-cadence/label-stage")
def _() -> Channels:
    return {"opacity": through(frame, (ms(400), ms(500)), (0, 0.7))}


@law("neon-heart-pop.split-nameplate-cadence/particle")
def _() -> Channels:
    return {"opacity": (sin((frame / fps + 0.4) * PI * 2) * 0.5 + 0.5) * through(frame, (0, ms(300)), (0, 1), soft_out)}


# photo-glitch, beats of 22.3 frames
BEAT = 22.3
beat = floor(frame / BEAT)
in_beat = frame - beat * BEAT


@law("photo-glitch.beat-photo-cadence")
def _() -> Channels:
    kind, snap = beat % 4, spring(in_beat, Spring(14, 0.7, 200))
    rest = lerp(1.08, 1, progress(in_beat, 0, 8))
    side = when((beat % 8).equals(1), -1, 1)
    scale = when(kind.equals(0), lerp(1.5, 1, ease_out(lambda v: power(v, 3))(progress(in_beat, 0, 6))), when(kind.equals(2), lerp(1.4, 1, snap), rest))
    return {"variant": kind, "beat": beat, "source": beat % SOURCES, "in_beat": in_beat, "opacity": term(1), "x": when(kind.equals(1), lerp(side * 1080, 0, snap), 0), "y": when(kind.equals(3), lerp(1920, 0, snap), 0), "scale": scale, "rotate": when(kind.equals(2), lerp(15, 0, snap), 0)}


@law("photo-glitch.beat-vignette-flicker")
def _() -> Channels:
    return {"beat": beat, "in_beat": in_beat, "opacity": 0.6 + sin(frame * 0.9) * 0.04}


ENTRANCES = ((0, 0, -1200, 14, 110), (10, -1200, 0, 16, 120), (20, 1200, 0, 16, 120))
for _k, _e in enumerate(ENTRANCES):

    @law(f"photo-glitch.masked-panel-reveal/{_k}")
    def _(e=_e) -> Channels:
        delay, x, y, damping, stiffness = e
        amount = spring(frame - delay, Spring(damping, 1, stiffness))
        return {"x": lerp(x, 0, amount), "y": lerp(y, 0, amount), "opacity": progress(frame - delay, 0, 4)}


DRIFTS = ((1.12, -2, -3), (1, 3, 2), (1.13, -3, 3))
for _k, _d in enumerate(DRIFTS):

    @law(f"photo-glitch.panel-ken-burns/{_k}")
    def _(d=_d) -> Channels:
        passed = progress(frame, 0, duration)
        return {"scale": lerp(1, 1 + (d[0] - 1) * 0.5 + 0.12, passed), "x": lerp(0, d[1] * 6, passed), "y": lerp(0, d[2] * 6, passed)}


DROPS = ((0, -180, -120, -14, 18, -20, 0.92), (15, 200, -40, 12, -14, 22, 1), (30, -120, 180, 9, 20, 16, 0.96), (45, 150, 220, -10, -18, -18, 1.04))
for _k, _d in enumerate(DROPS):

    @law(f"photo-glitch.perspective-card-drop/{_k}")
    def _(d=_d) -> Channels:
        delay, x, y, turn, turn_x, turn_y, scale = d
        drop, settle = spring(frame - delay, Spring(16, 1.1, 90)), spring(frame - delay, Spring(11, 0.8, 120))
        return {"x": lerp(x * 0.3, x, settle), "y": lerp(-1300, y, drop), "z": lerp(600, 0, drop), "rotate_x": lerp(turn_x * 3, 0, drop), "rotate_y": lerp(turn_y * 2.5, 0, settle), "rotate": lerp(turn * 4, turn, settle), "scale": lerp(0.4, scale, drop), "opacity": progress(frame - delay, 0, 6)}


@law("photo-glitch.rgb-beat-glitch")
def _() -> Channels:
    phase = frame % BEAT
    on = phase < 4
    strength = when(on, lerp(5, 0, progress(phase, 0, 4)), 0)
    return {"strength": strength, "x": when(on, sin(frame * 7.3) * strength * 0.8, 0), "beat": beat}


@law("photo-glitch.triptych-exit")
def _() -> Channels:
    last = rounded(fps * 0.4)
    seen, gone = progress(frame, 0, 24), progress(frame, duration - last, last)
    return {"phase": when(gone > 0, "exit", when(seen < 1, "reveal", "hold")), "opacity": 1 - power(gone, 3), "present": when(gone < 1, 1, 0)}


# tape-warble
@law("tape-warble.vhs-tracking-error")
def _() -> Channels:
    return {"warp": clamp(frame / (duration * 0.2)), "roll_y": 1920 * (1 - frame / duration * 2 % 1)}


# turbulent-emulsion
@law("turbulent-emulsion.drift/neon")
def _() -> Channels:
    end, last = rounded(duration * 0.78), rounded(duration * 0.4)
    traced = bezier(0.45, 0, 0.25, 1)(progress(frame, 0, end))
    after = greatest(frame - end, 0)
    wobble = when(progress(frame, 0, end) >= 1, sin(after * 0.45) * 0.04 * exp(after * -0.03), 0)
    intro, gone = progress(frame, 0, 6), power(progress(frame, duration - last, last), 3)
    return {"opacity": intro * (1 - gone), "fill_opacity": when(traced < 0.75, 0, (traced - 0.75) / 0.25 * 0.16), "glow": 6 + traced * 10, "scale": (0.92 + intro * 0.08 + wobble) * (1 + gone * 0.18), "trace": traced}


@law("turbulent-emulsion.drift/handwritten-cues")
def _() -> Channels:
    return {"frequency_x": fixed(0.9 + sin(frame * 0.06) * 0.09, 4), "frequency_y": fixed(0.9 + cos(frame * 0.05) * 0.09, 4), "displacement": fixed(33 + sin(frame * 0.22) * 9 + sin(frame * 0.9) * 3, 2), "blur": fixed(10.6 + sin(frame * 0.35) * 1.4, 2), "seed": floor(frame / 3)}


@law("turbulent-emulsion.drift/soft-grain")
def _() -> Channels:
    return {"frequency": fixed(0.95 + sin(frame * 0.6) * 0.02, 4), "seed": frame % 991 + 1}


for _variant in ("dense-grain", "film-grain"):

    @law(f"turbulent-emulsion.drift/{_variant}")
    def _(variant=_variant) -> Channels:
        seed = frame % 9973 if variant == "dense-grain" else (frame * 7 + 3) % 9973
        return {"fine_seed": seed, "dust_seed": (seed * 3 + 17) % 9973}


for _k, _at in enumerate((4, 20, 34, 98, 113, 130, 142)):
    law(f"turbulent-emulsion.flicker/cue-{_k}")(lambda at=_at: {"present": when(frame >= at, 1, 0)})
for _variant, _numbers in {"soft-grain": (0.0325, 0.2, 0.0075), "dense-grain": (0.39, 0.9, 0.03), "film-grain": (0.38, 0.75, 0.03)}.items():
    law(f"turbulent-emulsion.flicker/{_variant}")(lambda n=_numbers: {"opacity": n[0] + sin(frame * n[1]) * n[2]})


# kinetic-intertitles: how many letters or words there are, and which of them this is
COUNT, INDEX = argument("letters", 6), argument("letter_index", 2)
FLICKER = (
    (0.08, 0.72, 0.22, 0.88, 0.38, 1), (0.18, 0.58, 0.82, 0.28, 0.68, 1), (0.04, 0.78, 0.18, 0.72, 0.48, 1), (0.28, 0.48, 0.92, 0.18, 0.62, 1),
    (0.12, 0.38, 0.84, 0.32, 0.52, 1), (0.22, 0.65, 0.35, 0.78, 0.42, 1), (0.06, 0.82, 0.15, 0.68, 0.55, 1),
)


def closing() -> T:
    last = rounded(fps * 0.5)
    return progress(frame, duration - last, last)


def breath() -> T:
    since = greatest(0, frame - ((COUNT - 1) * 4 + 12))
    return 1 + sin(since * 0.04) * 0.03 * progress(since, 0, 30)


def sweep(amount: T, peak: float) -> T:
    return when(amount <= 0.08, lerp(0, peak, progress(amount, 0, 0.08)), when(amount <= 0.92, peak, lerp(peak, 0, progress(amount, 0.92, 0.08))))


@law("kinetic-intertitles.impact-letter-cadence/scanline-row")
def _() -> Channels:
    return {"opacity": 1 - closing(), "brightness": 1 + 0.05 * sin(frame * PI * 16 / fps)}


@law("kinetic-intertitles.impact-letter-cadence/scanline-letter")
def _() -> Channels:
    typed, local = COUNT * 5, frame - INDEX * 5
    glow = 1 + 0.45 * sin((frame - typed) * 0.065) * progress(frame, typed - 5, 25)
    return {"opacity": when(local < 0, 0, when(local < 6, pick([x for own in FLICKER for x in own], (INDEX % len(FLICKER)) * 6 + least(5, greatest(0, floor(local)))), 1)), **{f"blur_{b}": glow * b for b in (18, 36, 54, 80)}}


for _side, _strength in (("back", 0.6), ("front", 1.0)):
    law(f"kinetic-intertitles.impact-letter-cadence/spring-{_side}-row")(lambda s=_strength: {"opacity": s * (1 - closing()), "scale": breath()})

    @law(f"kinetic-intertitles.impact-letter-cadence/spring-{_side}-letter")
    def _(side=_side) -> Channels:
        amount = spring(frame - INDEX * 4, Spring(8, 1, 120))
        return {"opacity": amount, "scale": greatest(0.01, amount) if side == "front" else amount}


@law("kinetic-intertitles.impact-scanline-sweep")
def _() -> Channels:
    amount = progress(frame, COUNT * 5 + 12, 22)
    return {"present": when(amount > 0, 1, 0), "opacity": sweep(amount, 0.9), "y": lerp(-12, 108, amount)}


@law("kinetic-intertitles.progress-trace")
def _() -> Channels:
    start, whole = rounded(fps * 0.6) + rounded(fps * 0.06) + rounded(fps * 0.38), rounded(fps * 0.65)
    rise, fall = start + rounded(fps * 0.1), start + whole - rounded(fps * 0.3)
    opacity = when(frame <= rise, lerp(0, 0.9, progress(frame, start, rise - start)), when(frame <= fall, lerp(0.9, 0.6, progress(frame, rise, fall - rise)), lerp(0.6, 0, progress(frame, fall, start + whole - fall))))
    return {"opacity": opacity, "y": 64 + progress(frame, start, whole) * 80}


@law("kinetic-intertitles.shimmer-sweep")
def _() -> Channels:
    enter = rounded(fps * 0.6)
    amount = progress(frame, enter + rounded(fps * 0.08), rounded(fps * 1.05))
    return {"opacity": sweep(amount, 0.45) * cubic_out(progress(frame, 0, enter)) * (1 - power(closing(), 3)), "x": lerp(-280, 280, amount)}


@law("kinetic-intertitles.split-word-cadence/shimmer")
def _() -> Channels:
    enter, word = rounded(fps * 0.6), rounded(fps * 0.3)
    start = enter + INDEX * rounded(fps * 0.16)
    middle = start + word * 0.5
    scale = when(frame <= middle, lerp(1, 1.055, progress(frame, start, middle - start)), lerp(1.055, 1, progress(frame, middle, start + word - middle)))
    return {"opacity": cubic_out(progress(frame, 0, enter)) * (1 - power(closing(), 3)), "scale": scale}


@law("kinetic-intertitles.split-word-cadence/plain")
def _() -> Channels:
    own = frame - INDEX * rounded(fps * 0.6) / COUNT
    return {"opacity": progress(own, 0, rounded(fps * 0.12)) * (1 - closing()), "scale": 0.7 + spring(own, Spring(15, 0.55, 85)) * 0.3}


# sculptural-3d
for _variant, _bpm in (("slow-pulse", 117.5), ("fast-pulse", 161.5)):

    @law(f"sculptural-3d.heart-pulse-orbit/{_variant}")
    def _(bpm=_bpm) -> Channels:
        punch = 1 - spring(frame % (fps * 60 / bpm), Spring(7, 0.22, 210))
        return {"inner_opacity": 0.11 + 0.3 * punch, "outer_opacity": 0.04 + 0.22 * punch, "intensity": 3 + 5 * punch, "orbit_frame": frame, "y": sin(frame * 0.034) * 15, "turn": frame * 0.0065, "scale": 1.1 + 0.28 * punch}


@law("sculptural-3d.ink-tendril-reveal")
def _() -> Channels:
    return {"progress": (1 - cos(clamp(frame / greatest(1, duration - 1)) * PI)) / 2, "time": frame * 0.1}


@law("sculptural-3d.scissor-snap-flight/impact")
def _() -> Channels:
    flight = spring(frame, Spring(18, 0.9, 90))
    gone, whole = power(progress(frame, rounded(fps * 2.5), rounded(fps * 0.5)), 3), fps * 0.35
    snap = through(frame - rounded(fps * 0.65), (0, whole * 0.5, whole), (1, 0.02, 0.08), cubic_out)
    return {"blade": 0.22 + snap * 0.45, "x": 8 - 8 * flight, "y": sin(frame * 0.025) * 0.12, "turn_x": sin(frame * 0.018) * 0.04, "scale": flight * (1 - gone)}


@law("sculptural-3d.scissor-snap-flight/minimal")
def _() -> Channels:
    fade = rounded(fps * 0.5)
    return {"entrance": spring(frame - 10, Spring(18, 1.4, 50)), "open": spring(frame, Spring(20, 1.2, 60)) * 0.32, "opacity": through(frame, (0, fade, duration - fade, duration), (0, 1, 1, 0)), "y": sin(frame * 0.035) * 0.06, "turn_y": sin(frame * 0.018) * 0.18}


def stage_exit() -> T:
    return 1 - power(progress(frame, rounded(fps * 2.5), rounded(fps * 0.5)), 3)


def shimmer() -> T:
    return lerp(0.85, 1.15, (sin(frame * 0.07) + 1) / 2)


def stage_in() -> T:
    return clamp(frame / 4)


@law("sculptural-3d.scissors-stage-cadence/minimal-stage")
def _() -> Channels:
    fade = rounded(fps * 0.5)
    return {"opacity": through(frame, (0, fade, duration - fade, duration), (0, 1, 1, 0))}


@law("sculptural-3d.scissors-stage-cadence/minimal-copy-group")
def _() -> Channels:
    enter = spring(frame, Spring(22, 1, 55))
    return {"y": lerp(60, 0, enter), "scale": lerp(0.75, 1, enter)}


@law("sculptural-3d.scissors-stage-cadence/minimal-mark")
def _() -> Channels:
    wave = (sin(frame * 0.07) + 1) / 2
    return {"opacity": lerp(0.6, 1, wave), "glow": lerp(18, 38, wave)}


law("sculptural-3d.scissors-stage-cadence/impact-large-glow")(lambda: {"opacity": stage_in() * stage_exit() * shimmer()})
law("sculptural-3d.scissors-stage-cadence/impact-core-glow")(lambda: {"opacity": stage_in() * stage_exit(), "y": sin(frame * 0.025) * 6})
law("sculptural-3d.scissors-stage-cadence/impact-atmosphere")(lambda: {"opacity": stage_in() * stage_exit() * 0.6, "angle": frame * 0.5})
law("sculptural-3d.scissors-stage-cadence/impact-mark")(lambda: {"brightness": shimmer()})
law("sculptural-3d.scissors-stage-cadence/impact-detail")(lambda: {"brightness": shimmer(), "blur": term(0.5)})


@law("sculptural-3d.scissors-stage-cadence/impact-snap-flash")
def _() -> Channels:
    start = rounded(fps * 0.9)
    return {"flash": through(frame, (start, start + 4, start + 10), (0, 0.55, 0))}


@law("sculptural-3d.scissors-stage-cadence/impact-copy-group")
def _() -> Channels:
    return {"opacity": stage_in() * stage_exit(), "scale": spring(frame - 5, Spring(20, 0.8, 85)) * stage_exit(), "y": sin(frame * 0.033) * 3}


# fight-zine
@law("fight-zine.boiling-ink")
def _() -> Channels:
    held = floor(frame / 2)
    return {"add_x": noise(1.1, held, 3.5), "add_y": noise(2.2, held, 3.5), "add_rotate": noise(3.3, held, 0.55)}


@law("fight-zine.row-stagger")
def _() -> Channels:
    settle = back_out(progress(frame, 0, 14), 1.45)
    return {"opacity": progress(frame, 0, 4), "rotate": lerp(-2.8, 0, settle), "scale_x": lerp(0.96, 1, settle), "scale_y": lerp(1.04, 1, settle), "x": lerp(-120, 0, settle), "brightness": lerp(1.18, 1, settle)}


@law("fight-zine.fight-night-shutter-hit/deck")
def _() -> Channels:
    local = frame % (duration / 3)
    left = when(local < 12, 1 - local / 12, 0)
    return {"x": sin(frame * 2.7) * 24 * left, "y": cos(frame * 3.3) * 18 * left}


@law("fight-zine.fight-night-shutter-hit/strobe")
def _() -> Channels:
    seen = through(frame % (duration / 3), (0, 3, 9), (0.5, 0.18, 0))
    return {"opacity": seen, "present": when(seen > 0, 1, 0)}


@law("fight-zine.fight-night-shutter-hit/flash")
def _() -> Channels:
    third = duration / 3
    hit = lambda at, peak: through(frame, (at, term(at) + 2, term(at) + 9), (0, peak, 0))
    flash = greatest(hit(0, 0.95), hit(rounded(third), 0.9), hit(rounded(third * 2), 0.9), hit(rounded(third * 0.5), 0.4), hit(rounded(third * 1.5), 0.4))
    return {"opacity": flash, "present": when(flash > 0, 1, 0), "brightness": 1 + flash * 0.25}


@law("conn-check-88bf76acecbb.marker")
def _() -> Channels:
    settled = cubic_out(progress(frame, 0, 18))
    return {"opacity": progress(frame, 0, 8), "scale": lerp(0.72, 1, settled), "y": lerp(40, 0, settled)}
