from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from orrery.llm import near_dedup as near


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Smallest doc_id of each component of the graph of likeness 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        low[root(i)].append(doc)
    return {doc: min(low[root(i)]) for i, (doc, _) in enumerate(rows)}


def cloud(n, base, rng, cut=False, most=7):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(0, most)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        if cut and rng.random() < 0.5:
            own = own[: rng.randrange(60, len(own))]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("cut", "most", "seed"), [(False, 7, 8), (True, 7, 9), (True, 12, 10), (False, 4, 11)])
def test_classes_equal_brute_force(spark, cut, most, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(3):
        base = [f"v{rng.randrange(500)}" for _ in range(rng.choice([70, 150]))]
        texts += cloud(90, base, rng, cut, most) + [" ".join(base)] * 3
    texts += [" ".join(f"v{rng.randrange(500)}" for _ in range(80)) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute(rows)
    missed = sum(got[d] != want[d] for d in want)
    assert missed == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = keys[:220], keys[60:]
    wa, wb = rng.uniform(0.5, 2, 300)[:220], rng.uniform(0.5, 2, 300)[60:]
    x, y = np.zeros(300), np.zeros(300)
    x[:220], y[60:] = wa, wb
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(60, 220))
    made = near.signatures([a, b], [wa, wb], 4096)
    assert abs((made[0] == made[1]).mean() - exact) < 0.03


def test_signature_of_a_set_is_the_same_in_any_batch():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (4, 9, 100, 3000)]
    ones = [np.ones(len(s)) for s in sets]
    together = near.signatures(sets, ones)
    for k, s in enumerate(sets):
        assert (near.signatures([s], [ones[k]])[0] == together[k]).all()


def test_odd_texts(odd, empty):
    got = near.classes(odd).collect()
    assert len(got) == odd.count()
    by = {(r["doc_id"], r["class_id"]) for r in got}
    assert by == {(1, 1), (5, 1), (9, 1), (2, 2), (3, 3), (4, 4), (None, None), (7, 7), (8, 8)}
    kept = near.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert near.classes(empty).count() == 0


def test_repetition_does_not_hide_near_copies(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for k in range(60):
        # What differs is a passage that each copy repeats a thousand times and more.
        shared = [word() for _ in range(80)]
        for j in (0, 1):
            rows.append((2 * k + j, " ".join(shared + [word() for _ in range(3)] * 1500)))
    sets = [shingles(t) for _, t in rows]
    assert all(len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2))
    bands = {r["doc_id"]: set(r["bands"]) for r in near.signed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = {i: set(near.band_keys(near.signatures([near.Shingler()(t)[0]], [np.ones(len(sets[i]))]))[0].tolist()) for i, t in rows}
    assert all(bands[i] >= plain[i] for i, _ in rows)
    assert all(bands[i] & bands[i + 1] for i in range(0, len(rows), 2))


def classes_of(rows):
    """As `brute`, over sets held as bits, for thousands of texts."""
    place = {}
    bits = []
    for _, t in rows:
        own = 0
        for s in shingles(t):
            own |= 1 << place.setdefault(s, len(place))
        bits.append(own)
    sizes, label = [b.bit_count() for b in bits], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]):
                shared = (bits[i] & bits[j]).bit_count()
                if sizes[i] and shared >= 0.8 * (sizes[i] + sizes[j] - shared):
                    label[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(doc, low.get(root(i), doc))
    return {doc: low[root(i)] for i, (doc, _) in enumerate(rows)}


def test_a_family_of_thousands_costs_a_few_comparisons_each(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"v{rng.randrange(500)}" for _ in range(90)]
    # A second family beside the first: alike enough to share buckets with it, not to be linked.
    other = base[:76] + [f"u{rng.randrange(500)}" for _ in range(14)]
    texts = cloud(1500, base, rng, most=9) + cloud(900, other, rng, most=5) + cloud(300, base, rng, cut=True) + [" ".join(base)] * 300
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    compared, plain = [], near.verified

    def counted(pairs, sets, spread=False):
        if not spread:
            compared.append(pairs.count())
        return plain(pairs, sets, spread)

    monkeypatch.setattr(near, "verified", counted)
    got = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == classes_of(rows)
    assert sum(compared) <= 8 * len(rows)


def test_components(spark):
    rng = random.Random(5)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    chain, star = names[:200], names[200:300]
    links = [*zip(chain, chain[1:], strict=False), *((star[0], x) for x in star[1:]), (names[300], names[301])]
    got = {r["node"]: r["label"] for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(names[:302])
    for part in (chain, star, names[300:302]):
        assert len({got[x] for x in part}) == 1 and got[part[0]] in part
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0
