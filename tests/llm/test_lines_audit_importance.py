"""Line dedup, filter audit and importance resampling by brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import filter_audit, importance, line_dedup, queries
from orrery.llm.common import shared_dir
from orrery.llm.cuckoo import Cuckoo, TooFull

SF = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"
WHITE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_filter_audit", "op13_importance_resample", "secret_counts", "edited_texts"])
def test_queries_and_their_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    wanted = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(wanted.fetchall(), key=str)


# Lines


def key_of(line):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    return own if len(own) >= 10 else None


def lines_by_hand(held, rows):
    """held: (doc_id, text) of the index; rows: those asked for."""
    last = 1 << 70
    holders = defaultdict(set)
    for d, t in held:
        for line in (t or "").split("\n"):
            if key_of(line):
                holders[key_of(line)].add(last if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        own = last if d is None else d
        left = [x for x in lines if not key_of(x) or len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == own]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def deduped(index, docs):
    return sorted((tuple(r) for r in index.dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def texts(rng, n, kinds=60):
    lines = [f"{'Line' if i % 3 else '行の内容は十文字以上です'} number {i} of many" for i in range(kinds)] + ["short", "", "ninechars", "tenéchars!", " \t padded line here \r"]
    return ["\n".join(rng.choice((str, str.upper))(rng.choice(lines)) + rng.choice(("", " ", "\r")) for _ in range(rng.randrange(0, 8))) for _ in range(n)]


def test_lines_of_odd_and_empty_tables(spark, odd, empty):
    docs = odd.unionByName(spark.createDataFrame([(4, "THE QUICK BROWN FOX \r\nnew line it is", "en", "a", 0, "k", 1.0, [1]), (None, "no id here\nno id here", None, None, 0, "k", 1.0, [1])], odd.schema)).withColumn("n_dropped", F.lit("x"))
    index = line_dedup.LineIndex(spark, shared_dir(spark))
    index.insert(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert deduped(index, docs) == lines_by_hand(rows, rows)
    got = index.dedup(docs)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped", "kept_text"]
    assert {r["kept"] for r in got.collect()} == {"extra", "k"}
    none = line_dedup.LineIndex(spark, shared_dir(spark))
    none.insert(empty)
    assert none.dedup(empty).count() == 0 and deduped(none, odd.filter("doc_id = 1")) == [(1, 2, 0, "The quick brown fox\njumps over the lazy dog")]


@pytest.mark.parametrize("hot", [1000, 3])
def test_lines_inserted_and_deleted(spark, monkeypatch, hot):
    """Any state reached by insertions and deletions is that of an index of what is left."""
    monkeypatch.setattr(line_dedup, "HOT_LEAST", hot)
    rng = random.Random(hot)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = list(enumerate(texts(rng, 90)))
    path = shared_dir(spark)
    index = line_dedup.LineIndex(spark, path, shard_keys=8)
    first, second = rows[:50], rows[50:] + [(None, rows[3][1]), (200, rows[4][1])]
    index.insert(frame(first))
    assert deduped(index, frame(first)) == lines_by_hand(first, first)
    index.insert(frame(second))
    held = first + second
    assert deduped(index, frame(held)) == lines_by_hand(held, held)
    gone = set(rng.sample(range(90), 40)) | {None}
    index.delete(frame([(d, None) for d in gone]).unionByName(frame([(999, "x")])))
    held = [r for r in held if r[0] not in gone]
    again = line_dedup.LineIndex(spark, path)
    assert (again.version, again.shards) == (3, index.shards)
    assert deduped(again, frame(held)) == lines_by_hand(held, held)
    # The exact table, and filters that say no less.
    holders = defaultdict(set)
    for d, t in held:
        for k in filter(None, map(key_of, (t or "").split("\n"))):
            holders[hashlib.blake2b(k.encode(), digest_size=16).digest()].add(d)
    assert {(bytes(r["key"]), r["docs"], r["owner"]) for r in again.counts().collect()} == {(k, len(v), min(v)) for k, v in holders.items()}
    found = {bytes(r["key"]): r["entries"] for r in again.through(again.counts().select("key")).collect()}
    assert found.keys() == holders.keys() and all(found[k] >= min(2, len(holders[k])) for k in holders)
    exact = {r["shard"]: r["entries"] for r in again.filters().collect()}
    assert sum(exact.values()) == sum(min(2, len(v)) for v in holders.values())
    # Everything goes, and comes again.
    index = line_dedup.LineIndex(spark, path)
    index.delete(frame(held))
    assert index.counts().count() == 0 and deduped(index, frame(held)) == [(d, (t or "").count("\n") + 1, 0, t or "") for d, t in sorted(held, key=lambda x: str((x[0], (x[1] or "").count("\n") + 1)))]
    index.insert(frame(first))
    assert deduped(index, frame(first)) == lines_by_hand(first, first)


def test_a_version_that_was_never_committed_is_written_over(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    path, rows = shared_dir(spark), [(1, "a line of some length"), (2, "a line of some length")]
    index = line_dedup.LineIndex(spark, path)
    index.insert(frame(rows[:1]))
    frame([(7, "x")]).select(F.lit(b"x").alias("key"), "doc_id", F.lit(1).cast("long").alias("change")).write.parquet(f"{path}/postings/v2")
    index = line_dedup.LineIndex(spark, path)
    index.insert(frame(rows[1:]))
    assert deduped(index, frame(rows)) == [(1, 1, 0, "a line of some length"), (2, 1, 1, "")]
    assert index.postings().count() == 2


def test_cuckoo_filters_lose_no_key():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000, 20_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        own = Cuckoo.sized(2 * n)
        own.insert(np.concatenate((keys, keys[: n // 2])))
        true = np.array([2] * (n // 2) + [1] * (n - n // 2))
        assert (own.count(keys) >= true).all() and (own.count(keys) == true).mean() > 0.99 if n else True
        other = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
        assert (own.count(other) > 0).mean() < 1e-3
        own = Cuckoo.read(own.raw())
        own.delete(keys[: n // 2])
        own.delete(keys[n // 2 :])
        assert (own.count(keys) >= (true > 1)).all() and (own.table > 0).sum() == n // 2
    full = Cuckoo.sized(8)
    with pytest.raises(TooFull):
        full.insert(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    with pytest.raises(KeyError):
        Cuckoo.sized(8).delete(np.array([5], np.uint64))
    many = Cuckoo.sized(8)
    many.insert(np.array([7, 7, 7, 9], np.uint64))
    many.delete(np.array([7, 7], np.uint64))
    assert many.count(np.array([7, 9], np.uint64)).tolist() == [1, 1]


# Filters


def mask_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + 8 * bool(re.search("[#$%&*|]", text))


def audit_by_hand(rows, labels, filters="ABCDE"):
    """rows: (doc_id, text, source); every order walked document by document."""
    last, first = 1 << 70, {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", last + 1), last if d is None else d)
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for d, t, s in rows:
        parts[s or ""].append((mask_of(t or "") + 16 * ((last if d is None else d) > first[t or ""]), d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        own, shapley = [], Counter()
        for order in itertools.permutations(range(5)):
            left = docs
            for step, f in enumerate(order):
                removed = [x for x in left if x[0] >> f & 1]
                left = [x for x in left if not x[0] >> f & 1]
                shapley[f] += len(removed)
                failing = sum(x[0] >> f & 1 for x in docs)
                own.append((part, "".join(filters[i] for i in order), step + 1, len(left), len(removed), failing - len(removed), sum(x[0] == 1 << f for x in docs), sum(x[1] for x in removed), sum(x[2] for x in removed), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in own]
    return sorted(out)


def test_filters_by_hand(spark, odd, empty):
    rng = random.Random(2)
    words = ["alpha", "BETA", "gamma", "#tag", "delta", "ÉÀ", "x|y"] + [f"w{i}" for i in range(400)]
    rows = [(rng.choice([i, i, None, 7]), rng.choice([None, "", " ".join(rng.choices(words[: rng.choice((3, 400))], k=rng.choice((5, 220, 500)))), "same text", "same text"]), rng.choice(["a", "b", None, "", "é"])) for i in range(300)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in [*range(0, 300, 2), None, 7, 7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("x")).withColumn("digest", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("z"))
    got = filter_audit.audit(filter_audit.masks(docs, known))
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, labels)
    got = filter_audit.audit(filter_audit.masks(odd, known.limit(0)))
    assert sorted(map(tuple, got.collect())) == audit_by_hand([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], [])
    assert filter_audit.audit(filter_audit.masks(empty, known)).count() == 0


def test_thresholds_of_filters():
    for text in ("a " * 199, "a b " * 100, "A" + "b" * 49, "A" + "b" * 48, "AB" + "é" * 98, "AB" + "é" * 97, "x&", "", "\x1f \x85\xa0 b", "a\x0bb\x0cc\x1cd"):
        assert filter_audit.text_mask(text.encode()) == mask_of(text), text


def test_orders_are_visited_by_single_swaps(spark):
    for k in range(1, 7):
        order, seen = list(range(k)), [tuple(range(k))]
        for i in filter_audit.plain_changes(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(k)))
    cells = spark.createDataFrame([("p", 3, 4, 1, 0), ("p", 1, 2, 0, 2), ("p", 0, 1, 0, 0), ("p", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (1, 7, 0, 2, 1, 2, 9), ("XY", 2): (1, 0, 5, 0, 0, 0, 5), ("YX", 1): (3, 5, 0, 0, 1, 0, 5), ("YX", 2): (1, 2, 5, 2, 0, 2, 9)}


# Importance


def features_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket_of(feature):
    return zlib.crc32(feature.encode()) % 10_000


TEXTS = ["", None, "one", "One two, two-THREE", "é漢字 Straße_x9 9x", "\x00\x7f ~~~ ", "w" * 5000 + " tail", " ".join(f"word{i}" for i in range(3000)), "a b c " * 50, "x" * 47 + " " + "y" * 48 + " " + "z" * 49, "áb c", "." * 300]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 22])
def test_features_of_arrow_columns(size):
    for column in (pa.array(TEXTS), pa.array(["skip me", *TEXTS])[1:], pa.array([t for t in TEXTS if t is not None]).slice(2, 5), pa.array([], pa.string())):
        words, got = Counter(), defaultdict(list)
        for word, row, bucket in importance.features(column, size):
            words.update(word.tolist())
            for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
                got[r].append(b)
        for r, text in enumerate(column.to_pylist()):
            own, feats = features_of(text)
            assert words[r] == len(own) and sorted(got[r]) == sorted(map(bucket_of, feats))


def drawn_by_hand(rows, target):
    corpus, wanted = Counter(), Counter()
    for _, t in rows:
        corpus.update(map(bucket_of, features_of(t)[1]))
    for t in target:
        wanted.update(map(bucket_of, features_of(t)[1]))
    s_all, t_all, out = sum(corpus.values()), sum(wanted.values()), []
    for d, t in rows:
        words, feats = features_of(t)
        gains = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000)))) for b in map(bucket_of, feats)]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(words), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((i for i, r in enumerate(out) if r[1] >= 20), key=lambda i: (-out[i][4], 1 << 70 if out[i][0] is None else out[i][0]))
    ranks = {i: n + 1 for n, i in enumerate(order[: 25 * len(order) // 100])}
    return sorted(((*r, ranks.get(i)) for i, r in enumerate(out)), key=str)


def test_draw_by_hand(spark, odd, empty):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)] + ["Ünï", "THE", "the"]
    # A third of all rows share one id and one text.
    rows = [(5, "one text of many words " * 6)] * 150 + [(rng.choice([i, i, i, None]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.choice((3, 19, 20, 60))))])) for i in range(300)]
    target = ["the w1 w2 w3", None, "THE w1 w2"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, bench)
    assert sorted(map(tuple, got.collect()), key=str) == drawn_by_hand(rows, target)
    # No target at all, and odd rows.
    got = importance.resample(odd, bench.limit(0))
    assert sorted(map(tuple, got.collect()), key=str) == drawn_by_hand([(r["doc_id"], r["text"]) for r in odd.collect()], [])
    assert importance.resample(empty, bench).count() == 0
