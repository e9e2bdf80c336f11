"""Deterministic noise and hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables
from .timeline import col

M32 = 0xFFFFFFFF


def fraction(x: Column) -> Column:
    return x - F.floor(x)


def frame_noise(frame: Column, seed: Column | float = 0) -> Column:
    """In -1 to 1."""
    return fraction(F.sin(col(frame) * 78.233 + col(seed) * 12.9898) * 43758.5453) * 2 - 1


def boil(seed: Column, frame: Column, amplitude: float, held: int = 2) -> Column:
    """Noise that is held for a few frames."""
    bucket = F.floor(col(frame) / held)
    return (fraction(F.sin(col(seed) * 12.9898 + bucket * 78.233) * 43758.5453) - 0.5) * 2 * amplitude


def jitter(seed: Column, amplitude: float) -> Column:
    return (fraction(F.sin(col(seed) * 12.9898) * 43758.5453) - 0.5) * 2 * amplitude


def pseudo_random(seed: Column) -> Column:
    return fraction(F.sin(col(seed) * 127.1 + 311.7) * 43758.5453)


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32))


def multiply32(a: Column, b: Column | int) -> Column:
    """Product of unsigned 32-bit integers modulo 2**32, by halves, since a long can't hold it."""
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    high = low32(F.shiftrightunsigned(a, 16) * b)
    return low32(F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b)


def mulberry(seed: Column, index: Column) -> Column:
    """A sample in 0 to 1 for a seed and an index, from 32-bit mixing."""
    state = low32(low32(seed.cast("long")) + multiply32(low32(index.cast("long") + 1), 0x6D2B79F5))
    v = multiply32(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    v = low32(v + multiply32(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseXOR(v)
    return v.bitwiseXOR(F.shiftrightunsigned(v, 14)) / 4294967296.0


#: Starting states and multipliers of the four lanes, and the code that ends a token. Fixed values.
LANES = ((0x811C9DC5, 0x01000193), (0x9E3779B9, 0x27D4EB2F), (0x85EBCA6B, 0x165667B1), (0xC2B2AE35, 0x85EBCA77))
END = 0x10FFFF
#: As few lists as this are faster one by one.
ALONE = 8


def utf16_units(text: Column) -> Column:
    """UTF-16 code units of a text, as longs."""
    body = F.hex(F.encode(text, "UTF-16BE"))
    return F.transform(F.sequence(F.lit(0), (F.length(body) / 4).cast("int") - 1), lambda i: F.conv(F.substring(body, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))


def token_codes(text: Column) -> Column:
    """What a token feeds into the hash: its length, its units, and the end."""
    units = F.when(F.length(text) > 0, utf16_units(text)).otherwise(F.array().cast("array<long>"))
    return F.concat(F.array(F.size(units).cast("long")), units, F.array(F.lit(END).cast("long")))


def token_hash(tokens: Column) -> Column:
    """32 hexadecimal digits for an array of strings: four lanes of multiply and shift. For whole tables see `batch_hash`."""

    def lane(codes: Column, start: int, prime: int) -> Column:
        def mix(state: Column, code: Column) -> Column:
            x = multiply32(low32(state.bitwiseXOR(code)), prime)
            return x.bitwiseXOR(F.shiftrightunsigned(x, 16))

        return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(start).cast("long"), mix))), 8, "0")

    # In a lambda, so that the lanes share one list of codes.
    codes = F.array(F.flatten(F.transform(tokens, token_codes)))
    return F.get(F.transform(codes, lambda c: F.concat(*(lane(c, s, p) for s, p in LANES))), F.lit(0))


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 code units of all texts in a row, and how many each has."""
    units = np.frombuffer("".join(texts).encode("utf-16-le"), "<u2").astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if sizes.sum() != len(units):
        sizes = np.fromiter((len(t.encode("utf-16-le")) // 2 for t in texts), np.int64, len(texts))
    return units, sizes


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What tokens feed into the hash, their length, units and the end, and where each token's codes begin."""
    units, sizes = units_of(texts)
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))
    codes, inside = np.empty(starts[-1], np.uint32), np.ones(starts[-1], bool)
    codes[starts[:-1]], codes[starts[1:] - 1] = sizes, END
    inside[starts[:-1]] = inside[starts[1:] - 1] = False
    codes[inside] = units
    return codes, starts


def hashes(tokens: pa.Array) -> pa.Array:
    """Hashes of lists of tokens: a place of all lists at once, and those longer than nearly all others one by one."""
    codes, starts = codes_of(tokens.flatten().fill_null("").to_pylist())
    ends = np.concatenate(([0], np.cumsum(np.asarray(tokens.value_lengths().fill_null(0), np.int64))))
    first, last = starts[ends[:-1]], starts[ends[1:]]
    longest = np.argsort(first - last, kind="stable")
    first, size = first[longest], (last - first)[longest]
    state = np.repeat(np.array([[s] for s, _ in LANES], np.uint64), len(size), axis=1)
    primes = np.array([[p] for _, p in LANES], np.uint64)
    going, at = int(np.count_nonzero(size)), 0
    while going > ALONE:
        x = (state[:, :going] ^ codes[first[:going] + at]) * primes & np.uint64(M32)
        state[:, :going] = x ^ x >> np.uint64(16)
        at += 1
        going -= int(np.searchsorted(size[:going][::-1], at, side="right"))
    for row in range(going):
        own = codes[first[row] + at : first[row] + size[row]].tolist()
        for lane, (_, prime) in enumerate(LANES):
            x = int(state[lane, row])
            for code in own:
                x = (x ^ code) * prime & M32
                x ^= x >> 16
            state[lane, row] = x
    out = np.empty((len(size), len(LANES)), ">u4")
    out[longest] = state.T
    text = out.tobytes().hex()
    digests = pa.array([text[i : i + 32] for i in range(0, len(text), 32)], pa.string())
    return pc.if_else(tokens.is_valid(), digests, pa.scalar(None, pa.string())) if tokens.null_count else digests


def batch_hash(tokens: Column) -> Column:
    """The digits of `token_hash` for tokens that take no lambdas to make, many rows at once: over Arrow batches."""
    tables.importable(SparkSession.active())
    return F.arrow_udf(hashes, "string")(tokens)


def number_key(x: Column) -> Column:
    """A double as text that tells zeros apart by sign."""
    plain = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))
    zero = F.when(x.cast("string") == "-0.0", "-0").otherwise("0")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, zero).otherwise(plain)


def record_tokens(value: Column, kind: T.DataType) -> Column:
    """The tokens that a plain value feeds into the hash, each type under its own tag: array<string>.

    Arrays give their length and items, records their number of fields and then name and value of each, in
    the order of names; what is null is `null`."""
    tokens = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    if isinstance(kind, T.BooleanType):
        own = F.array(F.when(value, "boolean:true").otherwise("boolean:false"))
    elif isinstance(kind, T.StringType):
        own = F.array(F.lit("string"), value)
    elif isinstance(kind, T.NumericType):
        own = F.array(F.lit("number"), number_key(value.cast("double")))
    elif isinstance(kind, T.ArrayType):
        items = F.flatten(F.transform(value, lambda x: F.concat(F.array(F.lit("item")), record_tokens(x, kind.elementType))))
        own = F.concat(tokens("array", F.size(value)), items)
    elif isinstance(kind, T.StructType):
        parts = [tokens("object", F.lit(len(kind.fields)))]
        for f in sorted(kind.fields, key=lambda f: f.name):
            parts += [F.array(F.lit(f.name)), record_tokens(value[f.name], f.dataType)]
        own = F.concat(*parts)
    else:
        raise TypeError(f"{kind.simpleString()} is no plain data")
    return F.when(value.isNull(), F.array(F.lit("null"))).otherwise(own)


def record_hash(rows: DataFrame, *columns: str) -> Column:
    """32 hexadecimal digits for the record of these columns of rows."""
    kind = T.StructType([rows.schema[c] for c in columns])
    return token_hash(record_tokens(F.struct(*columns), kind))
