"""Laws of flash photographs: slots of reframed images, exposures and grades. Numbers are fixed values.

A slot is shown in [start, end) and moves from start to `till`; its channels go from one value to
another with a curve. Times are milliseconds, or frames where a recipe says so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.envelopes import FLASH, FLASH_MS
from .catalogue import Channels, law
from .terms import argument, clamp, fps, frame, greatest, lerp, ms, PI, power, T, term, when

CURVES = {"": lambda v: v, "in": lambda v: v * v, "out": lambda v: 1 - power(1 - v, 2), "out3": lambda v: 1 - power(1 - v, 3)}


@dataclass(frozen=True)
class Slot:
    start: float
    end: float | None
    till: float
    moves: dict[str, tuple] = field(default_factory=dict)


@dataclass(frozen=True)
class Recipe:
    basis: str
    slots: tuple[Slot, ...]
    exposed: bool = False
    fade: tuple[float, str] = (0, "")


def still(frames: float, fade_ms: float, curve: str = "", **moves: tuple) -> Recipe:
    return Recipe("frames", (Slot(0, None, frames, moves),), fade=(fade_ms, curve))


def timed(*slots: tuple, exposed: bool = False, basis: str = "time") -> Recipe:
    return Recipe(basis, tuple(Slot(start, end, till if till else end, moves) for start, end, till, moves in slots), exposed)


RECIPES: dict[str, Recipe] = {
    "vignette-push": still(49, 60, "out", scale=(1, 1.1, "out3")),
    "vertical-reveal": still(61, 60, y=(0, -30)),
    "shutter-pullback": still(61, 60, scale=(1.08, 1)),
    "long-push": still(158, 80, scale=(1, 1.06)),
    "lateral-drift": still(61, 60, scale=(1.1, 1.1), x=(0, -40)),
    "paired-tilt": timed((0, 33, 33, {"rotate": (0.052, 0), "scale": (1.15, 1)}), (33, None, 67, {"rotate": (0, -0.052), "scale": (1, 1.15)}), basis="segments"),
    "paired-snap": timed((0, 558, None, {"scale": (1.25, 1), "x": (-40, 0)}), (558, None, 1115, {"scale": (1, 1.25), "x": (0, 40)})),
    "blue-triptych": timed((0, 743, None, {"scale": (1.05, 1.05), "x": (100, 0)}), (743, 1486, None, {"rotate": (0.07, 0), "scale": (1.18, 1)}), (1486, None, 2229, {"rotate": (0, -0.052), "scale": (1, 1.18), "y": (-50, 0)})),
    "balanced-triptych": timed((0, 750, None, {"scale": (1, 1.12), "x": (-40, 40)}), (750, 1500, None, {"rotate": (-0.087, 0), "scale": (1.2, 1)}), (1500, None, 2252, {"rotate": (0, 0.087), "scale": (1, 1.15), "y": (40, 0)})),
    "graded-triptych": timed((0, 750, None, {"rotate": (-0.052, 0), "scale": (1, 1.2, "in")}), (750, 1500, None, {"rotate": (0, 0.052), "scale": (1.2, 1, "out")}), (1500, None, 2252, {"scale": (1, 1.2, "in"), "y": (60, 0)}), exposed=True),
    "cross-pan-triptych": timed((0, 758, None, {"scale": (1, 1.12), "y": (70, -70)}), (758, 1516, None, {"rotate": (0.07, 0), "scale": (1.15, 1), "x": (70, -70)}), (1516, None, 2275, {"rotate": (-0.07, 0), "scale": (1, 1.15), "y": (-50, 0)}), exposed=True),
    "cover-triptych": timed((0, 743, None, {"rotate": (0.052, 0), "scale": (1, 1.12)}), (743, 1486, None, {"scale": (1.15, 1), "x": (-60, 60)}), (1486, 2229, None, {"rotate": (-0.052, 0), "scale": (1, 1.15)})),
    "vignette-triptych": timed((0, 735, None, {"rotate": (0, 0.052), "scale": (1, 1.22)}), (735, 1470, None, {"rotate": (0.052, -0.052), "scale": (1.22, 1)}), (1470, None, 2206, {"rotate": (-0.052, 0), "scale": (1, 1.22)})),
    "counterturn-triptych": timed((0, 743, None, {"rotate": (0.087, 0), "scale": (1.18, 1)}), (743, 1486, None, {"scale": (1, 1.18), "y": (60, -60)}), (1486, None, 2229, {"rotate": (-0.087, 0), "scale": (1.18, 1), "x": (40, 0)}), exposed=True),
    "four-beat-fade": timed((0, 600, None, {"rotate": (0.052, 0), "scale": (1, 1.15)}), (600, 1200, None, {"rotate": (0, -0.052), "scale": (1.15, 1)}), (1200, 1800, None, {"scale": (1, 1.15), "x": (-50, 0)}), (1800, None, 2996, {"scale": (1, 1.12)})),
    "wide-angle-triptych": timed((0, 751, None, {"scale": (1, 1), "y": (-60, 60)}), (751, 1502, None, {"rotate": (-0.1, 0), "scale": (1.2, 1)}), (1502, None, 2253, {"rotate": (0, 0.1), "scale": (1, 1.2), "x": (0, 50)}), exposed=True),
    "scatter-five": timed(*((at, None, at + 100, {"x": (x0, x, "out"), "y": (y0, y, "out"), "rotate": (turn, turn)}) for at, x, y, turn, x0, y0 in ((580, 750, 520, 0.21, 1300, 100), (905, 280, 820, -0.14, -350, 1000), (1138, 580, 1150, 0.09, 580, -600), (1486, 200, 1400, -0.24, -450, 1600), (1741, 820, 1100, 0.05, 1400, 900)))),
}
#: Of each recipe with any: contrast, saturation, and filters of its media.
GRADES = {"graded-triptych": (1.15, 1.2, "none"), "cover-triptych": (1.2, 1.3, "none"), "vignette-triptych": (1, 1, "saturate(1.5) contrast(1.1)")}
#: The order in which a recipe's moves become transform operations; others go into the pose.
ORDERS = {
    "vignette-push": "scale", "long-push": "scale", "vertical-reveal": "translate-y", "lateral-drift": "translate-x scale", "paired-snap": "translate scale", "blue-triptych": "translate rotate scale",
    "balanced-triptych": "scale rotate translate", "cover-triptych": "scale rotate", "four-beat-fade": "rotate scale translate",
}
#: x, width and height of the frame that covers a composition, whose middle is the origin.
COVER, MIDDLE = (-180, 1440, 1920), (540, 960)
time = frame / fps * 1000


def flash(points: tuple[float, ...], at: T = time, length: float = FLASH_MS) -> T:
    peak = term(0)
    for p in points:
        since = at - p
        peak = greatest(peak, when((since >= 0) & (since < length), (1 - since / length) * FLASH, 0))
    return peak


for _name, _recipe in RECIPES.items():
    for _k, _slot in enumerate(_recipe.slots):

        @law(f"flash-photo.shutter-flash-reframe/{_name}-{_k}")
        def _(name=_name, recipe=_recipe, slot=_slot) -> Channels:
            at = time if recipe.basis == "time" else frame
            amount = clamp((at - slot.start) / (slot.till - slot.start))
            seen = when(at >= slot.start, 1 if slot.end is None else when(at < slot.end, 1, 0), 0)
            if recipe.basis == "frames":
                seen = CURVES[recipe.fade[1]](clamp(frame / greatest(1, ms(recipe.fade[0]))))
            out = {c: lerp(m[0], m[1], CURVES[m[2] if len(m) > 2 else ""](amount)) for c, m in slot.moves.items()}
            if "rotate" in out:
                out["rotate"] = out["rotate"] * (180 / PI)
            contrast, saturate, filters = GRADES.get(name, (1, 1, "none"))
            scattered = name == "scatter-five"
            if scattered:
                out |= {"frame_x": out.pop("x"), "frame_y": out.pop("y"), "frame_width": term(620)}
            elif name == "cover-triptych":
                x, y = term(COVER[0]) + out.get("x", 0), term(0) + out.get("y", 0)
                out |= {"frame_x": x, "frame_y": y, "frame_width": term(COVER[1]), "frame_height": term(COVER[2]), "origin_x": MIDDLE[0] - x, "origin_y": MIDDLE[1] - y}
            still_there = term(1) if recipe.basis == "frames" else when(seen > 0, 1, 0)
            media = {"contrast": term(contrast), "saturate": term(saturate), "filters": term(filters), "fit": term("contain" if scattered else "cover"), "shadow": term("6px 8px 25px rgba(0,0,0,0.6)" if scattered else "none")}
            return {"opacity": seen, "present": still_there, "operations": term(ORDERS.get(name, "none"))} | media | out

    if _recipe.exposed:
        law(f"flash-photo.shutter-flash-reframe/{_name}-exposure")(lambda r=_recipe: {"exposure": flash(tuple(s.start for s in r.slots))})

law("flash-photo.exposure-bloom/paired-tilt")(lambda: {"opacity": flash((0, 33), frame, 5)})
for _name, _points in {"paired-snap": (0, 558), "blue-triptych": (0, 743, 1486), "balanced-triptych": (0, 750, 1500), "cover-triptych": (0, 743, 1486), "vignette-triptych": (0, 735, 1470), "four-beat-fade": (0, 600, 1200, 1800)}.items():
    law(f"flash-photo.exposure-bloom/{_name}")(lambda p=_points: {"opacity": flash(p)})
law("flash-photo.exposure-bloom/four-beat-fade-grade")(lambda: {"opacity": clamp((time - 2500) / 496)})
# outlined-word-card: a word and the frames from which and up to which it is there
APPEAR, DISAPPEAR = argument("appear_frame", 9), argument("disappear_frame", 20)
law("outlined-word-card.word-cue-state")(lambda: {"present": when((frame >= APPEAR) & (frame < DISAPPEAR), 1, 0)})
