"""Plain data of any shape: VARIANT columns walked by path, hashed and compared.

Objects are taken in the order of their keys by UTF-16 code units, so that equal values have equal tokens
whatever order they were written in. A key that isn't there, and one whose value is null, are told apart, and so are
whole numbers, zeros by sign, NaN and infinities, as far as the value has them: JSON text has none of the last, values
made from typed columns (`to_variant_object`) do.

All is expressions of one row. How deep values go is asked of the table once (`depth_of`), and an expression goes that
deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import number_key, token_hash

NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def depth_of(rows: DataFrame, *columns: str) -> int:
    """Levels of objects and arrays, at most, in these columns: of each nesting of brackets, found once."""
    nestings = rows.select(F.explode(F.array(*(brackets(F.to_json(c)) for c in columns))).alias("b")).distinct()
    return nestings.agg(F.max(nested(F.col("b")))).first()[0] or 0


def brackets(text: Column) -> Column:
    """The brackets of JSON text, those inside strings aside."""
    return F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]+", "")


def levels(text: Column) -> Column:
    """How deep brackets nest in JSON text, those inside strings aside."""
    return nested(brackets(text))


def nested(text: Column) -> Column:
    marks = F.split(text, "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: expressions inside lambdas are computed again for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(value: Column) -> Column:
    """null, boolean, string, number, array, object, or other (binary, times), which is no plain data."""
    return bound(F.schema_of_variant(value), lambda name: _kind(value, name))


def _kind(value: Column, name: Column) -> Column:
    number = name.startswith(NUMBERS[0])
    for n in NUMBERS[1:]:
        number = number | name.startswith(n)
    return (
        F.when(value.isNull() | (name == "VOID"), "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(number, "number").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("other")
    )


def members(value: Column) -> Column:
    return F.variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    return F.variant_get(value, "$", "array<variant>")


def in_order(keys: Column) -> Column:
    """Keys by their UTF-16 code units."""
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(F.hex(F.encode(k, "UTF-16BE")).alias("units"), k.alias("key")))), lambda s: s["key"])


def scalar(value: Column, kind: Column) -> Column:
    """Tokens of what isn't a container."""
    text = F.variant_get(value, "$", "string")
    number = number_key(F.variant_get(value, "$", "double"))
    own = F.when(kind == "boolean", F.array(F.concat(F.lit("boolean:"), text))).when(kind == "string", F.array(F.lit("string"), text)).when(kind == "number", F.array(F.lit("number"), number))
    return own.when(kind == "null", F.array(F.lit("null"))).otherwise(F.array(F.raise_error(F.lit("no plain data")).cast("string")))


def tokens(value: Column, depth: int) -> Column:
    """What a value feeds into a hash: array<string>, as functions.noise.record_tokens does for typed records."""
    return bound(opened(value), lambda o: _tokens(o["value"], o["kind"], o["held"], o["listed"], depth))


def opened(value: Column) -> Column:
    """A value with its kind, and its members or items if it has any."""
    parts = lambda kind: F.struct(value.alias("value"), kind.alias("kind"), F.when(kind == "object", members(value)).alias("held"), F.when(kind == "array", items(value)).alias("listed"))
    return bound(kind_of(value), parts)


def _tokens(value: Column, kind: Column, held: Column, listed: Column, depth: int) -> Column:
    if depth <= 0:
        return scalar(value, kind)
    fields = F.flatten(F.transform(in_order(F.map_keys(held)), lambda k: F.concat(F.array(k), tokens(F.element_at(held, k), depth - 1))))
    parts = F.flatten(F.transform(listed, lambda x: F.concat(F.array(F.lit("item")), tokens(x, depth - 1))))
    size = lambda c: F.size(c).cast("string")
    own = F.when(kind == "object", F.concat(F.array(F.lit("object"), size(held)), fields)).when(kind == "array", F.concat(F.array(F.lit("array"), size(listed)), parts))
    return own.otherwise(scalar(value, kind))


def plain_hash(value: Column, depth: int) -> Column:
    """32 hexadecimal digits: equal to functions.noise.record_hash of an equal record."""
    return token_hash(tokens(value, depth))


def digest(value: Column, depth: int) -> Column:
    """SHA-256 of the tokens, each with its length before it, so that no two lists of tokens read alike."""
    return F.sha2(F.array_join(F.transform(tokens(value, depth), lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)), "").cast("binary"), 256)


def leaves(value: Column, depth: int, path: Column | None = None, ordered: bool = True) -> Column:
    """array<struct<path, value>>: every scalar and every empty container of a value. Paths are `$`, `$.key` with a plain
    key, `$["key"]` (as JSON text) with any other, and `$[0]`.

    ordered: whether keys are taken in order, which what looks leaves up by path doesn't need."""
    at = F.struct(opened(value).alias("o"), (F.lit("$") if path is None else path).alias("path"))
    return bound(at, lambda s: _leaves(s["o"]["value"], s["o"]["kind"], s["o"]["held"], s["o"]["listed"], s["path"], depth, ordered))


def _leaves(value: Column, kind: Column, held: Column, listed: Column, path: Column, depth: int, ordered: bool) -> Column:
    leaf = lambda shown: F.array(F.struct(path.alias("path"), shown.alias("value")))
    # A string's own text may look like anything; tokens are told apart by their tags.
    alone = leaf(F.array_join(scalar(value, kind), " "))
    if depth <= 0:
        return alone
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)\A\[(.*)\]\z", 1)
    step = lambda k: F.when(k.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(path, F.lit("."), k)).otherwise(F.concat(path, F.lit("["), quoted(k), F.lit("]")))
    if ordered:
        below = F.flatten(F.transform(in_order(F.map_keys(held)), lambda k: leaves(F.element_at(held, k), depth - 1, step(k))))
    else:
        below = F.flatten(F.transform(F.map_entries(held), lambda e: leaves(e["value"], depth - 1, step(e["key"]), False)))
    inside = F.flatten(F.transform(listed, lambda x, i: leaves(x, depth - 1, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), ordered)))
    return F.when(kind == "object", F.when(F.size(held) == 0, leaf(F.lit("object"))).otherwise(below)).when(kind == "array", F.when(F.size(listed) == 0, leaf(F.lit("array"))).otherwise(inside)).otherwise(alone)


def differences(left: Column, right: Column, depth: int) -> Column:
    """array<string>: the paths at which two values differ, in order; of a path that only one of them has, that path."""
    as_map = lambda v: F.map_from_entries(leaves(v, depth, ordered=False))
    both = F.struct(as_map(left).alias("l"), as_map(right).alias("r"))
    differ = lambda s: F.array_sort(F.filter(F.array_union(F.map_keys(s["l"]), F.map_keys(s["r"])), lambda p: ~F.element_at(s["l"], p).eqNullSafe(F.element_at(s["r"], p))))
    return bound(both, differ)


def disagreements(left: DataFrame, right: DataFrame, key: list[str], column: str) -> DataFrame:
    """key and path: where the values of two tables differ; of a key that one of them has alone, the path `$`."""
    depth = max(depth_of(left, column), depth_of(right, column))
    other = right.select(*(F.col(k).alias(f"__{k}") for k in key), F.col(column).alias("__other"), F.lit(True).alias("__there"))
    mine = left.select(*key, F.col(column).alias("__own"), F.lit(True).alias("__here"))
    both = mine.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "full")
    alone = F.col("__here").isNull() | F.col("__there").isNull()
    paths = F.when(alone, F.array(F.lit("$"))).otherwise(differences(F.col("__own"), F.col("__other"), depth))
    named = [F.when(F.col("__here").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in key]
    return both.select(*named, F.explode(paths).alias("path"))
