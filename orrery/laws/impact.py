"""Laws of impact cuts by recipe and role: ramps over authored times. Numbers are fixed values."""

from __future__ import annotations

from collections.abc import Callable

from .catalogue import Channels, law
from .terms import PI, T, absolute, bezier, ease_out, fps, frame, lerp, power, rounded, sin, term, through, when

sharp, even, plain = bezier(0.16, 1, 0.3, 1), bezier(0.45, 0, 0.55, 1), (lambda v: v)
seconds = frame / fps


def ramp(start, end, a: float, b: float, easing: Callable[[T], T] = plain) -> T:
    """From a to b between two frames."""
    return through(frame, (start, end), (a, b), easing)


def within(s: float) -> T:
    return rounded(fps * s)


def fade(s: float, a: float = 1, b: float = 0, easing: Callable[[T], T] = plain) -> T:
    return ramp(0, within(s), a, b, easing)


def beats(*frames: int) -> T:
    """1 at the given whole frames."""
    out = term(0)
    for f in frames:
        out = when(frame.equals(f), 1, out)
    return out


def slam() -> T:
    return fade(0.3, 0, 1, sharp)


def shown(x: T) -> Channels:
    return {"opacity": x, "present": when(x > 0, 1, 0)}


#: recipe: role: channels.
ROLES: dict[str, dict[str, Callable[[], Channels]]] = {
    "photo-depth-zoom": {
        "image": lambda: {"rotate_x": fade(0.8, -20, 0, sharp), "scale": fade(0.8, 0.9, 1.2, sharp)},
        "text": lambda: {"rotate_x": fade(0.3, 90, 0, sharp), "scale": fade(0.3, 1.3, 1, sharp)},
        "flash": lambda: {"opacity": fade(0.1)},
    },
    "photo-chroma-depth": {
        "image": lambda: {"rotate_x": fade(1, 6, 0, even), "scale": fade(1, 1, 1.12, even)},
        "gradient": lambda: {"y": fade(1, 20, 0, even)},
        "text": lambda: (lambda seen: {"opacity": seen, "rotate_x": lerp(45, 0, seen)})(ramp(within(0.3), within(0.3) + within(0.4), 0, 1, sharp)),
        "flash": lambda: {"opacity": fade(0.12)},
    },
    "photo-punch-2d": {
        "image": lambda: {"scale": ramp(0, fps * 2, 1, 1.2), "x": ramp(0, fps * 2, 0, -20)},
        "text": lambda: {"opacity": fade(0.4, 0, 1), "y": fade(0.4, 40, 0, ease_out(lambda v: power(v, 3)))},
        "flash": lambda: {"opacity": fade(0.1)},
    },
    "photo-screen-blend": {
        "image": lambda: {"scale": ramp(0, 90, 1.15, 1, even)},
        "red": lambda: {"opacity": fade(0.9, 0.3, 0)},
        "flash": lambda: {"opacity": ramp(0, 5, 1, 0)},
        "text": lambda: {"opacity": ramp(within(0.3), within(0.7), 0, 1, ease_out(bezier(0.42, 0, 1, 1)))},
    },
    "triptych-depth": {
        "image": lambda: (lambda side: {"scale": fade(0.4, 1, 1.3, sharp), "rotate_y": fade(0.4, 20, 0, sharp) + 5 * side, "x": 10 * side})(beats(3, 6, 9) - beats(4, 7, 10)),
        "ghost": lambda: {"present": beats(3, 4, 6, 7, 9, 10)},
        "red": lambda: {"alpha": absolute(sin(frame * 0.5)) * 0.2},
        "black": lambda: {"opacity": fade(0.06)},
    },
    "photo-shadow-punch": {"image": lambda: {"scale": fade(0.7, 1, 1.15, sharp)}, "black": lambda: {"opacity": fade(0.08)}},
    "collage-depth-outline": {
        "image": lambda: {"rotate_y": fade(1, -15, 0, sharp), "rotate_x": fade(1, 8, 0, sharp), "scale": fade(1, 1, 1.2, sharp)},
        "text": lambda: {"rotate_x": fade(0.3, -90, 0, sharp)},
        "flash": lambda: {"opacity": fade(0.15, 1, 0, ease_out(lambda v: v * v))},
    },
    "solid-card-depth": {"stage": lambda: {"opacity": fade(0.2, 0, 1)}, "ring": lambda: {"rotate_x": term(30), "rotate_y": frame % (fps * 1.2) / (fps * 1.2) * 360}},
    "type-depth-rise": {
        "stack": lambda: (lambda seen, done: {"rotate_y": lerp(-90, 0, seen) + when(done, sin(seconds * PI) * 8, 0), "rotate_x": when(done, sin(seconds * PI * 0.7) * 3, 0)})(ramp(0, 18, 0, 1, sharp), frame >= 18),
    },
    "type-depth-panel": {
        "stack": lambda: {"scale": when(seconds < 0.3, through(frame, (0, fps * 0.3), (1.3, 1)), 1), "rotate_y": sin(seconds * PI * 1.5) * 5},
        "ring": lambda: {"rotate_x": term(20), "rotate_y": seconds * 300},
    },
    "type-depth-stack": {
        "star-group": lambda: {"opacity": fade(0.3, 0, 1)},
        "star": lambda: {"rotate": seconds * 180, "rotate_x": sin(seconds) * 15},
        "text-group": lambda: {"opacity": ramp(within(0.3), within(0.7), 0, 1)},
        "text-stack": lambda: {"rotate_y": sin(seconds * 2) * 4},
    },
    "type-depth-stamp": {"stage": lambda: {"opacity": fade(0.3, 0, 1)}, "cube": lambda: {"rotate_x": seconds * 90, "rotate_y": seconds * 120}},
    "type-depth-tilt": {
        "stack": lambda: {"rotate_x": lerp(-60, 0, slam()), "scale": lerp(0.5, 1, slam()) * when(frame > within(0.3), 1 + 0.04 * sin((frame - within(0.3)) * 0.08), 1)},
    },
    "type-collage-depth": {
        "content": lambda: {"scale": through(frame % 30, (0, 8), (1.08, 1), sharp)},
        "chroma": lambda: shown(through(frame, (0, 4, 5), (1, 1, 0))),
        "glitch": lambda: (lambda on: {"opacity": on, "present": on})(when((frame >= 10) & (frame <= 12), 1, when((frame >= 40) & (frame <= 42), 1, 0))),
        "top-group": lambda: {"opacity": ramp(10, 28, 0, 1)},
        "top-text": lambda: {"rotate_y": sin(seconds * PI * 1.5) * 3},
        "bottom-group": lambda: {"opacity": ramp(30, 48, 0, 0.7)},
        "flash": lambda: shown(ramp(0, 5, 1, 0)),
    },
}
for _recipe, _roles in ROLES.items():
    for _role, _channels in _roles.items():
        law(f"impact.cut-cadence/{_recipe}-{_role}")(_channels)
