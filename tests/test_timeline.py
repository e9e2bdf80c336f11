from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import noise, text
from orrery.functions import timeline as tl


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, xs, f):
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").coalesce(1)
    return [r["v"] for r in rows.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("x", "ins", "outs", "left", "right", "want"),
    [(5, (0, 10, 20), (0, 100, 50), "extend", "extend", 50), (15, (0, 10, 20), (0, 100, 50), "extend", "extend", 75), (-4, (0, 10), (20, 40), "clamp", "extend", 20), (14, (0, 10), (20, 40), "extend", "identity", 14), (12, (0, 10), (0, 1), "extend", "wrap", 0.2)],
)
def test_interpolation_cases(spark, x, ins, outs, left, right, want):
    assert value(spark, tl.interpolate(F.lit(float(x)), ins, outs, left, right)) == pytest.approx(want)


def test_interpolation_needs_increasing_inputs():
    with pytest.raises(ValueError, match="increase"):
        tl.interpolate(1, (0, 0), (0, 1))


def stepped(config, frame, fps):
    return config.value(frame, fps)


@pytest.mark.parametrize("config", [tl.Spring(), tl.Spring(12, 0.8, 140), tl.Spring(40, 1, 100), tl.Spring(7, 0.22, 210)])
def test_spring_equals_stepping(spark, config):
    frames = [-3, 0, 0.25, 1, 1.5, 6, 12, 30, 59.75, 300, 5000]
    got = values(spark, frames, lambda x: tl.spring(x, 60, config))
    for f, g in zip(frames, got, strict=True):
        assert g == pytest.approx(stepped(config, min(f, 1000), 60), abs=1e-9)
    assert got[1] == 0


def test_spring_over_a_number_of_frames(spark):
    config = tl.Spring(12, 1, 100)
    natural = config.natural_frames(30)
    got = values(spark, [0, 6, 12, 13], lambda x: tl.spring(x, 30, config, frames=12))
    assert got[0] == 0 and got[3] == 1
    assert got[1] == pytest.approx(config.value(6 / (12 / natural), 30))
    assert tl.Spring().natural_frames(30, 0) == math.inf and tl.Spring().natural_frames(30, 1) == 0


def bezier(x, x1, y1, x2, y2):
    low, high = 0.0, 1.0
    at = lambda t, p, q: (((1 - 3 * q + 3 * p) * t + 3 * q - 6 * p) * t + 3 * p) * t
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if at(mid, x1, x2) > x else (mid, high)
    return at(low, y1, y2)


@pytest.mark.parametrize("points", [(0.42, 0, 0.58, 1), (0.16, 1, 0.3, 1), (0.4, 0, 0.6, 1), (0.45, 0, 0.25, 1), (0, 0, 1, 1), (0.25, 0.1, 0.25, 1)])
def test_bezier_follows_its_curve(spark, points):
    xs = [k / 40 for k in range(41)]
    for x, got in zip(xs, values(spark, xs, tl.cubic_bezier(*points)), strict=True):
        assert got == pytest.approx(bezier(x, *points), abs=2e-5)


def test_progress_without_a_duration(spark):
    assert [value(spark, tl.progress(F.lit(float(f)), 5, 0)) for f in (4, 5, 6)] == [0, 1, 1]


def test_rounding_is_half_up(spark):
    assert values(spark, [-2.5, -0.5, 0.5, 1.5, 2.5], tl.round_half_up) == [-2, 0, 1, 2, 3]


def mulberry(seed, index):
    m = 0xFFFFFFFF
    s = (seed + (index + 1) * 0x6D2B79F5) & m
    v = ((s ^ s >> 15) * (1 | s)) & m
    v = ((v + ((v ^ v >> 7) * (61 | v) & m)) & m) ^ v
    return (v ^ v >> 14) / 4294967296


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31), st.integers(0, 10**6)), min_size=50, max_size=50))
def test_mulberry(spark, pairs):
    rows = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<s: long, k: long>").coalesce(1)
    got = [r["v"] for r in rows.select("i", noise.mulberry(F.col("p.s"), F.col("p.k")).alias("v")).orderBy("i").collect()]
    assert got == [mulberry(s, k) for s, k in pairs]


def token_hash(tokens):
    m, lanes = 0xFFFFFFFF, [s for s, _ in noise.LANES]
    for t in tokens:
        raw = t.encode("utf-16-be")
        units = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]
        for code in [len(units), *units, noise.END]:
            for k, (_, prime) in enumerate(noise.LANES):
                x = (lanes[k] ^ code) * prime & m
                lanes[k] = x ^ x >> 16
    return "".join(f"{x:08x}" for x in lanes)


def test_token_hash(spark):
    for tokens in (["frame", "12"], ["", "a👍é"], ["x" * 300]):
        assert value(spark, noise.token_hash(F.array(*map(F.lit, tokens)))) == token_hash(tokens)


def test_token_hashes_of_many_lists_at_once(spark):
    """Lists of all lengths, also none and null, in one batch, which Arrow carries."""
    lists = [["é👍" * (i % 7), str(i)] * (i % 4) + ["x" * (i * i % 90)] * (i % 3) for i in range(200)] + [["y" * 3000], [], [""], None, [None]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, t array<string>").coalesce(1)
    hashed = rows.select("i", noise.batch_hash(F.col("t")).alias("h"))
    assert "ArrowEvalPython" in hashed._jdf.queryExecution().executedPlan().toString()
    assert [r["h"] for r in hashed.orderBy("i").collect()] == [None if t is None else token_hash([x or "" for x in t]) for t in lists]


def test_number_keys_tell_zeros_apart(spark):
    assert values(spark, [0.0, -0.0, 3, 2.5, math.nan, math.inf, -math.inf], noise.number_key) == ["0", "-0", "3", "2.5", "NaN", "+Infinity", "-Infinity"]


def test_utf16_length(spark):
    assert value(spark, text.utf16_length(F.lit("a👍"))) == 3


def test_identifiers_are_whole_strings(spark):
    assert value(spark, text.is_safe_id(F.lit("a.b-c_1"))) is True
    assert value(spark, text.is_safe_id(F.lit("abc\n"))) is False


def test_word_reveal(spark):
    shown = lambda f: value(spark, text.reveal_words(F.lit("ONE TWO  THREE FOUR FIVE"), F.lit(f)))
    assert shown(3) == "ONE TWO THREE" and shown(30) == "ONE TWO THREE FOUR FIVE"


def test_typing_reveals_in_uneven_steps(spark):
    pattern = text.TYPING
    for f in range(0, 60):
        steps = f - text.TYPING_START + 1
        want = 0 if steps <= 0 else min(60, sum(pattern[k % 8] for k in range(steps)))
        assert value(spark, text.typed_count(F.lit(float(f)), F.lit(60))) == want


def test_timecode(spark):
    assert value(spark, text.timecode(F.lit(3_600_000.0 * 30 / 10), F.lit(30.0))) == "100:00:00:00"
    assert value(spark, text.timecode(F.lit(95.0), F.lit(30.0))) == "00:00:03:05"


def test_css_string(spark):
    assert value(spark, text.css_string(F.lit('a"b\\c'))) == '"a\\"b\\\\c"'


def test_paths(spark):
    seg = "struct<command: string, x: double, y: double, x1: double, y1: double, x2: double, y2: double>"
    rows = spark.createDataFrame([([("M", 1.0, 2.0, None, None, None, None), ("Q", 5.0, 6.0, 3.0, 4.0, None, None), ("Z", None, None, None, None, None, None)],)], f"p array<{seg}>")
    assert rows.select(text.path_text(F.col("p")).alias("v")).first()["v"] == "M 1 2 Q 3 4 5 6 Z"


def integrated(config, fps, frame, parts=400):
    """Position by Runge-Kutta over the steps that a spring makes, none longer than 64 ms."""
    damping = config.damping if config.ratio < 1 else 2 * math.sqrt(config.stiffness * config.mass)
    slope = lambda x, v: (v, (config.stiffness * (1 - x) - damping * v) / config.mass)
    whole = int(frame)
    ends = [*range(1, whole), frame] if whole else [frame]
    x = v = last = 0.0
    for end in ends:
        h = min((end - last) / fps, 0.064) / parts
        last = end
        for _ in range(parts):
            a = slope(x, v)
            b = slope(x + h / 2 * a[0], v + h / 2 * a[1])
            c = slope(x + h / 2 * b[0], v + h / 2 * b[1])
            d = slope(x + h * c[0], v + h * c[1])
            x, v = x + h / 6 * (a[0] + 2 * b[0] + 2 * c[0] + d[0]), v + h / 6 * (a[1] + 2 * b[1] + 2 * c[1] + d[1])
    return x


@pytest.mark.parametrize("config", [tl.Spring(), tl.Spring(7, 0.22, 210), tl.Spring(30, 1, 100), tl.Spring(20, 1, 100)])
def test_springs_follow_the_oscillator_at_any_rate(spark, config):
    points = [(f, fps) for fps in (10.0, 24.0, 30.0, 60.0) for f in (0.0, 0.5, 1.0, 2.75, 9.0, 17.5)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, f double, fps double")
    got = [r["v"] for r in rows.select("i", tl.spring(F.col("f"), F.col("fps"), config).alias("v")).orderBy("i").collect()]
    for (f, fps), v in zip(points, got, strict=True):
        assert v == pytest.approx(integrated(config, fps, f), abs=1e-8)


@pytest.mark.parametrize("config", [tl.Spring(), tl.Spring(3, 1, 100), tl.Spring(0.4, 1, 1), tl.Spring(40, 1, 100)])
def test_settling_times(spark, config):
    def counted(fps, threshold=0.005):
        away = lambda f: abs(config.value(f, fps) - 1) >= threshold
        at = next(f for f in range(10**6) if not away(f))
        rest = 20
        while (f := next((f for f in range(at, at + rest + (rest == 20)) if away(f)), None)) is not None:
            at, rest = f + 1, 19
        return at

    rates = [12.5, 24.0, 29.97, 60.0]
    assert [config.natural_frames(r) for r in rates] == [counted(r) for r in rates]
    rows = spark.createDataFrame([(r,) for r in rates], "fps double")
    assert [r["v"] for r in rows.select("fps", tl._natural(config, F.col("fps"), 0.005).alias("v")).orderBy("fps").collect()] == [counted(r) for r in rates]
