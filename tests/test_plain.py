"""Values of any shape, against a walk in Python, and Merkle digests of trees."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from orrery.functions.noise import record_hash
from orrery.operators import merkle, plain


def value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind == 0:
        return rng.choice([0, 1, -3, 12.5, 1e300, 7])
    if kind == 1:
        return rng.choice(["", "a", "0", "é", "😀", "￿", 'q"\\', "null", "number 1"])
    if kind in (2, 3):
        return rng.choice([True, False]) if kind == 2 else None
    if kind in (4, 5) and depth:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if depth:
        return {k: value(rng, depth - 1) for k in rng.sample(["a", "b", "", "x y", "é", "😀", "￿", 'k"', "a.b", "0"], rng.randrange(5))}
    return "leaf"


def shuffled(rng, v):
    if isinstance(v, dict):
        own = list(v.items())
        rng.shuffle(own)
        return {k: shuffled(rng, x) for k, x in own}
    return [shuffled(rng, x) for x in v] if isinstance(v, list) else v


def number(x):
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else None


def walk(v):
    if v is None:
        return ["null"]
    if isinstance(v, bool):
        return [f"boolean:{str(v).lower()}"]
    if isinstance(v, str):
        return ["string", v]
    if isinstance(v, (int, float)):
        return ["number", number(v) or {12.5: "12.5", 1e300: "1.0E300"}[v]]
    if isinstance(v, list):
        return ["array", str(len(v)), *(t for x in v for t in ["item", *walk(x)])]
    return ["object", str(len(v)), *(t for k in sorted(v, key=lambda k: k.encode("utf-16-be")) for t in [k, *walk(v[k])])]


def found(v, path="$"):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            plain_key = k.isascii() and k.isidentifier()
            yield from found(x, f"{path}.{k}" if plain_key else f"{path}[{json.dumps(k, ensure_ascii=False)}]")
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from found(x, f"{path}[{i}]")
    else:
        yield path, tuple(walk(v)[:1] if isinstance(v, (dict, list)) else walk(v))


def test_values_of_any_shape(spark):
    rng = random.Random(1)
    values = [value(rng, 3) for _ in range(150)]
    pairs = [(i, v, shuffled(rng, v) if rng.random() < 0.4 else rng.choice(values)) for i, v in enumerate(values)]
    rows = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "id long, a string, b string").select("id", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    depth = plain.depth_of(rows, "a", "b")
    assert depth == 3
    got = rows.select("id", plain.tokens(F.col("a"), depth).alias("t"), plain.digest(F.col("a"), depth).alias("da"), plain.digest(F.col("b"), depth).alias("db"), plain.differences(F.col("a"), F.col("b"), depth).alias("differ"))
    for r in got.collect():
        _, a, b = pairs[r["id"]]
        assert r["t"] == walk(a)
        assert (r["da"] == r["db"]) == (walk(a) == walk(b))
        left, right = dict(found(a)), dict(found(b))
        assert r["differ"] == sorted((p for p in {*left, *right} if left.get(p) != right.get(p)), key=lambda p: p.encode()), (a, b)


def test_depths_of_texts(spark):
    rows = spark.createDataFrame([("1", 0), ('"[{"', 0), ('{"a[": 1}', 1), (r'{"a\\"[": [[], {"b": "}"}], "c": [[1]]}', 3), ("[]", 1)], "v string, n int")
    assert all(r["m"] == r["n"] for r in rows.select("n", plain.levels(F.col("v")).alias("m")).collect())


def test_typed_and_untyped_records_hash_alike(spark):
    rows = spark.sql("SELECT 1 AS id, named_struct('b', array(1.5D, double('NaN'), -0.0D), 'a', 'text', 'c', named_struct('y', true, 'x', CAST(NULL AS STRING))) AS v UNION ALL SELECT 2, named_struct('b', array(1.5D, double('NaN'), 0.0D), 'a', 'text', 'c', named_struct('y', true, 'x', CAST(NULL AS STRING)))")
    own = rows.select("id", record_hash(rows, "v").alias("typed"), plain.plain_hash(F.to_variant_object(F.struct("v")), 3).alias("loose")).collect()
    assert all(r["typed"] == r["loose"] for r in own) and own[0]["loose"] != own[1]["loose"]
    maps = spark.sql("SELECT map('k', 1, 'j', 2) AS a, map('j', 2, 'k', 1) AS b, map('j', 2) AS c").select(*(plain.plain_hash(F.to_variant_object(c), 1).alias(c) for c in "abc")).first()
    assert maps["a"] == maps["b"] != maps["c"]


def test_missing_and_null_are_told_apart(spark):
    rows = spark.createDataFrame([('{"a": null}', "{}"), ("[null]", "[]"), ("null", '"null"'), ("1", "1.0"), ("-0.0", "0")], "l string, r string").select(F.parse_json("l").alias("l"), F.parse_json("r").alias("r"))
    got = [r[0] for r in rows.select(plain.differences(F.col("l"), F.col("r"), 1)).collect()]
    assert got[:4] == [["$", "$.a"], ["$", "$[0]"], ["$"], []]


def test_tables_that_disagree(spark):
    table = lambda rows: spark.createDataFrame(rows, "k string, v string").select("k", F.parse_json("v").alias("v"))
    left = table([("a", '{"x": [1, 2]}'), ("b", "1"), (None, '{"y": 1}'), ("d", None)])
    right = table([("a", '{"x": [1, 3], "z": 0}'), ("c", "1"), (None, '{"y": 1}'), ("d", "null")])
    assert {tuple(r) for r in plain.disagreements(left, right, ["k"], "v").collect()} == {("a", "$.x[1]"), ("a", "$.z"), ("b", "$"), ("c", "$")}


def forest(rng, n):
    return {i: (None if i < 2 else rng.randrange(max(0, i - 12), i), rng.randrange(3), rng.choice("xyz")) for i in range(n)}


def test_merkle_digests_and_changes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 2)
    rng = random.Random(3)
    old = forest(rng, 40)
    new = {i: (p, o, "w" if i % 11 == 5 else k) for i, (p, o, k) in old.items() if i % 13 != 7}
    new |= {100: (0, 0, "x"), 101: (100, 0, "x"), 102: (3, 9, "y")}
    # What hangs on nothing any more is no part of the tree.
    reach = lambda t, i: i in t and (t[i][0] is None or reach(t, t[i][0]))
    below = lambda t, i: sum(1 for j in t if reach(t, j) and any(x == i for x in line(t, j)))

    def line(t, j):
        while j is not None:
            yield j
            j = t[j][0]

    frame = lambda t: spark.createDataFrame([(i, *v) for i, v in t.items()], "node_id long, parent_id long, ord int, kind string")
    a, b = (merkle.signed(frame(t), merkle.record_digest("kind")) for t in (old, new))

    def shape(t, i):
        own = sorted((j for j in t if t[j][0] == i), key=lambda j: (t[j][1], j))
        return (t[i][2], tuple(shape(t, j) for j in own))

    rows = a.collect()
    assert len(rows) == 40 and all(r["size"] == below(old, r["node_id"]) for r in rows)
    by_digest, by_shape = {}, {}
    for r in rows:
        by_digest.setdefault(r["digest"], set()).add(r["node_id"])
        by_shape.setdefault(shape(old, r["node_id"]), set()).add(r["node_id"])
    assert sorted(map(sorted, by_digest.values())) == sorted(map(sorted, by_shape.values()))
    assert {(r["first"], r["times"]) for r in merkle.interned(a).collect()} == {(min(v), len(v)) for v in by_digest.values()}
    want = {(i, "changed") for i in old if reach(new, i) and old[i][2] != new[i][2]}
    want |= {(i, "removed") for i in old if not reach(new, i) and (old[i][0] is None or reach(new, old[i][0]))}
    want |= {(i, "added") for i in new if i not in old and (new[i][0] is None or new[i][0] in old)}
    got = merkle.changes(a, b).collect()
    assert {(r["left_id"] if r["left_id"] is not None else r["right_id"], r["change"]) for r in got} == want and len(got) == len(want)
    assert {r["right_id"]: r["size"] for r in got if r["change"] == "added"} == {100: 2, 102: 1}
    assert merkle.changes(a, a).count() == 0 and merkle.signed(frame(old).limit(0), F.lit("")).count() == 0
