"""Terms of frame laws: a Spark column, and the SQL that says the same.

A law is declared once, as channels over terms. Spark evaluates the columns; the SQL, built by rules
of its own (springs as an amplitude and a phase, plain Newton iteration for curves), is there to compare with.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeline as tl


class T:
    """A term. Its column is made when it is first asked for, since that needs a running session."""

    def __init__(self, make: Callable[[], Column], sql: str | None) -> None:
        self.make, self.sql, self.made = make, sql, (None, None)

    @property
    def col(self) -> Column:
        now = SparkContext._active_spark_context
        if self.made[0] is not now or self.made[1] is None:
            self.made = (now, self.make())
        return self.made[1]

    def _with(self, other, f, sql: str, swap: bool = False) -> T:
        a, b = (term(other), self) if swap else (self, term(other))
        return T(lambda: f(a.col, b.col), None if a.sql is None or b.sql is None else sql.format(a.sql, b.sql))

    def __add__(self, o): return self._with(o, lambda a, b: a + b, "({} + {})")
    def __radd__(self, o): return self._with(o, lambda a, b: a + b, "({} + {})", True)
    def __sub__(self, o): return self._with(o, lambda a, b: a - b, "({} - {})")
    def __rsub__(self, o): return self._with(o, lambda a, b: a - b, "({} - {})", True)
    def __mul__(self, o): return self._with(o, lambda a, b: a * b, "({} * {})")
    def __rmul__(self, o): return self._with(o, lambda a, b: a * b, "({} * {})", True)
    def __truediv__(self, o): return self._with(o, F.try_divide, "({} / nullif({}, 0))")
    def __mod__(self, o): return self._with(o, lambda a, b: a % b, "({} % {})")
    def __lt__(self, o): return self._with(o, lambda a, b: a < b, "({} < {})")
    def __le__(self, o): return self._with(o, lambda a, b: a <= b, "({} <= {})")
    def __gt__(self, o): return self._with(o, lambda a, b: a > b, "({} > {})")
    def __ge__(self, o): return self._with(o, lambda a, b: a >= b, "({} >= {})")
    def __and__(self, o): return self._with(o, lambda a, b: a & b, "({} AND {})")
    def __neg__(self): return self * -1

    def equals(self, o) -> T: return self._with(o, lambda a, b: a == b, "({} = {})")


def term(x) -> T:
    if isinstance(x, T):
        return x
    if isinstance(x, str):
        return T(lambda: F.lit(x), "'" + x.replace("'", "''") + "'")
    return T(lambda: F.lit(float(x)), f"{float(x)!r}::DOUBLE")


def column(name: str) -> T:
    return T(lambda: F.col(name).cast("double"), f"{name}::DOUBLE")


frame, fps, duration = column("frame"), column("fps"), column("duration")
#: What laws take from their owner besides the frame, as columns of the row: type and what stands where none is given.
ARGUMENTS: dict[str, tuple[str, object]] = {}


def argument(name: str, default: float | str) -> T:
    """A column of the row that an owner gives."""
    ARGUMENTS[name] = ("string", default) if isinstance(default, str) else ("double", float(default))
    return T(lambda: F.col(name), name) if isinstance(default, str) else column(name)


def with_arguments(rows: DataFrame) -> DataFrame:
    """rows with a column for each argument of the laws: their own, or else the default."""
    return rows.withColumns({n: F.lit(x).cast(kind) for n, (kind, x) in ARGUMENTS.items() if n not in rows.columns})


def call(f: Callable[..., Column], sql: str, *args) -> T:
    own = [term(a) for a in args]
    return T(lambda: f(*(a.col for a in own)), None if any(a.sql is None for a in own) else sql.format(*(a.sql for a in own)))


def sin(x) -> T: return call(F.sin, "sin({})", x)
def cos(x) -> T: return call(F.cos, "cos({})", x)
def exp(x) -> T: return call(F.exp, "exp({})", x)
def absolute(x) -> T: return call(F.abs, "abs({})", x)
def floor(x) -> T: return call(lambda c: F.floor(c).cast("double"), "floor({})", x)
def rounded(x) -> T: return call(lambda c: tl.round_half_up(c).cast("double"), "floor({} + 0.5)", x)
def fixed(x, n: int) -> T: return call(lambda c: F.round(c, n), f"round({{}}, {n})", x)
def least(*xs) -> T: return call(F.least, "least(" + ", ".join(["{}"] * len(xs)) + ")", *xs)
def greatest(*xs) -> T: return call(F.greatest, "greatest(" + ", ".join(["{}"] * len(xs)) + ")", *xs)
def clamp(x, low=0, high=1) -> T: return least(high, greatest(low, x))
def ms(x) -> T: return rounded(term(x) / 1000 * fps)


def when(condition: T, yes, no) -> T:
    return call(lambda c, y, n: F.when(c, y).otherwise(n), "CASE WHEN {} THEN {} ELSE {} END", condition, yes, no)


def pick(values: Sequence[float], index: T) -> T:
    """values[index], for a whole index inside."""
    return T(lambda: F.get(F.array(*(F.lit(float(v)) for v in values)), index.col.cast("int")), None if index.sql is None else f"([{', '.join(repr(float(v)) for v in values)}][({index.sql} + 1)::INT])::DOUBLE")


def progress(at, start, length) -> T:
    sql = "CASE WHEN {2} <= 0 THEN CASE WHEN {0} >= {1} THEN 1.0 ELSE 0.0 END ELSE least(1.0, greatest(0.0, ({0} - {1}) / nullif({2}, 0))) END"
    return call(tl.progress, sql, at, start, length)


def lerp(a, b, amount: T) -> T:
    return term(a) + (term(b) - term(a)) * amount


def power(x: T, n: int) -> T:
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def cubic_out(x) -> T: return call(tl.ease_out_cubic, "(1 - (1 - least(1.0, greatest(0.0, {0}))) * (1 - least(1.0, greatest(0.0, {0}))) * (1 - least(1.0, greatest(0.0, {0}))))", x)
def back_out(x, overshoot: float = 1.70158) -> T:
    c = "(least(1.0, greatest(0.0, {0})) - 1)"
    return call(lambda v: tl.ease_out_back(v, overshoot), f"(1 + {overshoot + 1!r} * ({c} * {c} * {c}) + {overshoot!r} * ({c} * {c}))", x)
def smooth(x) -> T:
    c = "least(1.0, greatest(0.0, {0}))"
    return call(tl.smoothstep, f"({c} * {c} * (3 - 2 * {c}))", x)


def bezier(x1: float, y1: float, x2: float, y2: float) -> Callable[[T], T]:
    at = lambda t, p, q: f"((({1 - 3 * q + 3 * p!r} * {t} + {3 * q - 6 * p!r}) * {t} + {3 * p!r}) * {t})"
    slope = f"({3 * (1 - 3 * x2 + 3 * x1)!r} * t * t + {2 * (3 * x2 - 6 * x1)!r} * t + {3 * x1!r})"

    def ease(x: T) -> T:
        v = f"least(1.0, greatest(0.0, {x.sql}))"
        solved = f"list_reduce([{v}" + ", 0.0" * 40 + f"]::DOUBLE[], lambda t, z: least(1.0, greatest(0.0, t - ({at('t', x1, x2)} - ({v})) / (CASE WHEN abs({slope}) < 0.02 THEN 0.02 ELSE {slope} END))))"
        sql = f"(list_transform([{solved}], lambda u: {at('u', y1, y2)})[1])"
        return T(lambda: tl.cubic_bezier(x1, y1, x2, y2)(x.col), None if x.sql is None else sql)

    return ease


def ease_out(easing: Callable[[T], T]) -> Callable[[T], T]:
    return lambda x: 1 - easing(1 - x)


def through(x, inputs: Sequence, outputs: Sequence[float], easing: Callable[[T], T] = lambda v: v, extend: bool = False) -> T:
    """Piecewise linear, held at both ends unless extended. Inputs may be terms; they have to increase."""
    x, ins, outs = term(x), [term(i) for i in inputs], [term(o) for o in outputs]
    inside = x if extend else least(ins[-1], greatest(ins[0], x))
    found = None
    for k in range(len(ins) - 2, -1, -1):
        piece = outs[k] + (outs[k + 1] - outs[k]) * easing((inside - ins[k]) / (ins[k + 1] - ins[k]))
        found = piece if found is None else when(x <= ins[k + 1], piece, found)
    return found


def spring(at, config: tl.Spring = tl.Spring(), frames: float | None = None, rate=fps) -> T:
    """Of a time in frames, at a rate in frames a second."""
    at, rate = term(at), term(rate)
    make = lambda: tl.spring(at.col, rate.col, config, frames=frames)
    if at.sql is None or rate.sql is None:
        return T(make, None)
    now = f"greatest(0.0, {at.sql})"
    if frames is not None:
        settled = ", ".join(str(config.natural_frames(float(k))) for k in range(1, tl.RATES + 1))
        now = f"({now} / ({float(frames)!r}::DOUBLE / ([{settled}]::DOUBLE[])[({rate.sql})::INT]))"
    whole = f"greatest(0.0, floor({now}) - 1)"
    seconds = f"({whole} * least(1.0 / {rate.sql}, 0.064) + least(({now} - {whole}) / {rate.sql}, 0.064))"
    w, z = config.frequency, config.ratio
    if z >= 1:
        left = f"list_transform([{seconds}], lambda u: exp({-w!r} * u) * (1.0 + {w!r} * u))[1]"
    else:
        # As an amplitude and a phase.
        turn = w * math.sqrt(1 - z * z)
        left = f"list_transform([{seconds}], lambda u: exp({-z * w!r} * u) * {w / turn!r} * cos({turn!r} * u - {math.asin(z)!r}))[1]"
    late = f"CASE WHEN {at.sql} > {float(frames)!r}::DOUBLE THEN 1.0 ELSE" if frames is not None else ""
    return T(make, f"({late} 1.0 - {left}{' END' if late else ''})")


def joined(*parts) -> T:
    """Text of parts; numbers as whole ones."""
    own = [(term(p), isinstance(p, T)) for p in parts]
    sqls = [None if t.sql is None else f"({t.sql})::BIGINT::VARCHAR" if whole else t.sql for t, whole in own]
    return T(lambda: F.concat(*(t.col.cast("long").cast("string") if whole else t.col for t, whole in own)), None if None in sqls else " || ".join(sqls))


def noise(seed, bucket, amplitude: float) -> T:
    x = sin(term(seed) * 12.9898 + term(bucket) * 78.233) * 43758.5453
    return (x - floor(x) - 0.5) * 2 * amplitude


PI = math.pi
