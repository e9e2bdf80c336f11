from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from orrery.llm import exact_dedup, mixing


def test_modulus_is_a_safe_prime():
    def prime(n):
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41):
            x = pow(a, d, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
                return False
        return True

    assert prime(exact_dedup.MODULUS) and prime(exact_dedup.MODULUS // 2)


def test_fingerprints_compose():
    random.seed(1)
    data = random.randbytes(10_000)
    assert len({exact_dedup.fingerprint(data, c) for c in (1, 7, 64, 4096, 1 << 20)}) == 1
    assert exact_dedup.fingerprint(b"\0a") != exact_dedup.fingerprint(b"a")


def test_chunk_rows_equal_whole(spark):
    random.seed(2)
    texts = {i: random.randbytes(random.randrange(0, 5000)) for i in range(20)}
    rows = [(i, k, t[k * 700 : k * 700 + 700]) for i, t in texts.items() for k in range(len(t) // 700 + 1)]
    random.shuffle(rows)
    got = exact_dedup.fingerprint_chunks(spark.createDataFrame(rows, "doc_id long, chunk_no int, chunk binary")).collect()
    assert {r["doc_id"]: bytes(r["fingerprint"]) for r in got} == {i: exact_dedup.fingerprint(t) for i, t in texts.items()}


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    out = []
    for body, own in groups.items():
        best = min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
        for r in own:
            kept = r["doc_id"] == best["doc_id"] and len(r["text"] or "") == len(best["text"] or "")
            out.append((r["doc_id"], best["doc_id"], len(own), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def test_marks_equal_brute_force(spark, odd, empty):
    got = exact_dedup.mark_duplicates(odd).drop("n_points").collect()
    assert sorted(map(tuple, got), key=str) == brute(odd.collect())
    assert exact_dedup.mark_duplicates(empty).count() == 0


def test_hot_group_and_colliding_fingerprints(spark, monkeypatch):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 50}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.mark_duplicates(docs).drop("n_points").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs.collect())


def test_drop_keeps_columns_and_one_of_each(odd):
    got = exact_dedup.drop_duplicates(odd)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == sorted([-1, 4, 5, 7, 8])


def test_mix_reaches_targets(spark, odd, empty):
    plan = mixing.assign(odd).collect()
    assert len(plan) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in plan)
    by = defaultdict(int)
    for r in plan:
        by[r["target"], r["source_size"]] += r["taken"]
    assert all(t - 1 <= n <= t <= 2 * s for (t, s), n in by.items())
    assert sorted(map(str, mixing.assign(odd).collect())) == sorted(map(str, plan))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(len(r["positions"]) for r in plan)
    assert mixing.assign(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_demand_time_inverts_the_integral(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(0, 101).withColumn("u", mixing.F.col("id") / 100.0)
        for r in rows.withColumn("t", mixing.demand_time(mixing.F.col("u"), knots)).collect():
            area, whole = 0.0, 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
                whole += (t1 - t0) * (w0 + w1) / 2
                x = min(max(r["t"], t0), t1)
                area += (x - t0) * (w0 + w0 + (w1 - w0) * (x - t0) / (t1 - t0)) / 2
            assert abs(area / whole - r["u"]) < 1e-9
