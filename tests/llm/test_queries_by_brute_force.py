"""Queries without SQL, against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import exact_dedup, language, mixing, queries, secrets, token_store, toxicity

from .test_exact_dedup_and_mixing import brute as exact_classes
from .test_text_operators import brute_base

SF = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_secrets_of_every_document(spark, documents):
    names = ("assign", "access", "hex")
    got = {r["doc_id"]: r for r in queries.op1_secret_scan(spark, SF).collect()}
    assert set(got) == set(documents)
    for doc, r in got.items():
        base = brute_base(documents[doc]["text"] or "")
        written = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("novel:")] == written and len(spans) == len(written) + r["n_novel"]


def test_spans_of_odd_rows_are_code_points(spark):
    rows = [(1, None), (2, ""), (3, "👍é password=" + "x" * 12), (4, "👍 AKIA" + "Z" * 14), (5, "e" * 15 + " " + "e" * 16)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "assign:3:24", 4: "access:2:20", 5: "hex:16:32"}


def phrases(sample, text, stretch):
    """How many longest matches cover the text, a new one from each cut on; a letter that the sample
    doesn't have ends a match and belongs to the next."""
    count = 0
    for cut in range(0, len(text), stretch):
        count, current = count + 1, ""
        for c in text[cut : cut + stretch]:
            if current + c in sample:
                current += c
            else:
                count, current = count + 1, c if c in sample else ""
    return max(1, count)


def plain_letters(text):
    """Letters in lower case, with one blank for whatever stands between."""
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in out:
        out = out.replace("  ", " ")
    return out.removeprefix(" ")


def test_languages_by_plain_matching(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language.samples(docs, ~language.held_out(F.col("doc_id")))
    assert all(any(documents[d]["text"] in text for d in documents if crc(d, 4) != 2 and documents[d]["lang"] == lang) for lang, text in learned)
    # Held-out documents may have copies among the others.
    seen = "\n".join(r["text"] or "" for d, r in documents.items() if crc(d, 4) != 2)
    alone = [r["text"] for d, r in documents.items() if crc(d, 4) == 2 and r["text"] and r["text"] not in seen]
    assert len(alone) > 20 and not any(t in text for _, text in learned for t in alone)
    got = {r["doc_id"]: r for r in queries.op3_language(spark, SF).collect()}
    bodies = {lang: plain_letters(text)[: language.SAMPLE_SYMBOLS] for lang, text in learned}
    right = total = 0
    for doc in sorted(documents)[:40] + sorted(documents, key=lambda d: len(documents[d]["text"] or ""))[-3:-1]:
        text, r = plain_letters(documents[doc]["text"] or ""), got[doc]
        assert r["held_out"] == (crc(doc, 4) == 2)
        if len(text) < 6000:
            bits = {lang: phrases(body, text, language.STRETCH) * math.log2(len(body) + 2) / len(text) for lang, body in bodies.items()}
            best, second = sorted(bits.values())[:2]
            assert bits[r["lang_pred"]] == best and r["score"] == pytest.approx(1 - best / second)
    for doc, r in got.items():
        if r["held_out"] and documents[doc]["lang"]:
            total, right = total + 1, right + (r["lang_pred"] == documents[doc]["lang"])
    assert right >= 0.95 * total > 0


def test_languages_of_many_scripts(spark):
    rng = random.Random(8)
    ranges = {"ar": (0x627, 0x64A), "de": (0x61, 0x7A), "en": (0x61, 0x7A), "el": (0x3B1, 0x3C9), "ja": (0x3041, 0x3096), "ko": (0xAC00, 0xB000), "ru": (0x430, 0x44F), "zh": (0x4E00, 0x5800)}
    words = {lang: ["".join(chr(rng.randint(a, b)) for _ in range(rng.randint(2, 6))) for _ in range(300)] for lang, (a, b) in ranges.items()}
    write = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, write(lang, 9000 if lang in ("ko", "el") else 150), lang) for i, lang in enumerate(sorted(ranges) * 12)]
    learned = language.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(i, write(lang, 20), lang) for i, lang in enumerate(sorted(ranges) * 40)], "doc_id long, text string, lang string")
    right = Counter(r["lang"] for r in language.identify(asked, learned).collect() if r["lang"] == r["lang_pred"])
    assert all(right[lang] >= 38 for lang in ranges)


def test_two_hundred_languages_within_a_bound(spark):
    rng = random.Random(9)
    names = [f"l{i:03}" for i in range(200)]
    words = {lang: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 7))) for _ in range(150)] for lang in names}
    write = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, write(lang, 400), lang) for i, lang in enumerate(names * 12)]
    learned = language.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    most = language.quota(200)
    assert [lang for lang, _ in learned] == names and most < language.SAMPLE_SYMBOLS and language.quota(4) == language.SAMPLE_SYMBOLS
    assert sum(len(text) for _, text in learned) < language.ALL_SYMBOLS + 200 * 3200
    own = language.Parser(learned)
    held = sum(a.table.nbytes + a.keys.nbytes + a.to.nbytes + a.column.nbytes for a in own.automata)
    assert held < 600 << 20
    assert [lang for lang, _ in own.predict([write(lang, 40) for lang in names[::7]])] == names[::7]
    # Rows of languages with few labels go first.
    few = spark.createDataFrame([*rows[:300], *((10_000 + i, "rare words here", f"x{i:04}") for i in range(600))], "doc_id long, text string, lang string")
    kept = [lang for lang, _ in language.samples(few, F.lit(True))]
    assert len(kept) == language.LANGUAGES and set(names) <= set(kept)


def dense_fit(texts, names, pairs, rounds=300, rate=0.1):
    """The same model over dense matrices."""
    number = {w: i for i, w in enumerate(names)}
    flat = lambda many: np.array([[1.0 if w in own else 0.0 for w in names] for own in many]).reshape(len(many), len(number))
    x, left, right = flat([own for _, own, _ in texts]), flat([a for a, _ in pairs]), flat([b for _, b in pairs])
    y = np.array([label for *_, label in texts], float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    theta, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1])))
        slope = x.T @ (share * (p - y)) + toxicity.RIDGE * theta[:-1]
        change = (left - right) @ theta[:-1]
        slope += (left - right).T @ change * (2 * toxicity.SWAP_PENALTY / max(1, len(pairs)))
        slope = np.append(slope, (share * (p - y)).sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta


def test_toxicity_by_dense_matrices(spark, documents):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    sample = toxicity.sample(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    assert {d for d, _, _ in sample} == {str(d) for d in known if crc(d, 5) and d in documents and known[d] is not None}
    assert all(own == toxicity.tokens(documents[int(d)]["text"]) and y == known[int(d)] for d, own, y in sample)
    model = toxicity.fit(sample)
    counts = Counter(w for _, own, _ in sample for w in own)
    toxic, share = Counter(w for _, own, y in sample for w in own if y), sum(y for *_, y in sample) / len(sample)
    informative = {w for w, n in counts.items() if n >= toxicity.LEAST_TEXTS and abs(toxic[w] - n * share) >= toxicity.LEAST_Z * math.sqrt(n * share * (1 - share))}
    names = sorted(informative | {t for kind in toxicity.IDENTITY for t in kind})
    theta = dense_fit(sample, names, [(own, other) for seed, own, _ in sample for other in toxicity.swapped(own, seed)])
    assert model["bias"] == pytest.approx(theta[-1], abs=1e-6)
    for w, x in zip(names, theta, strict=False):
        assert model["weights"].get(w, 0.0) == pytest.approx(x, abs=2e-4)
    for r in queries.op8_toxicity(spark, SF).collect():
        z = model["bias"] + sum(model["weights"].get(w, 0.0) for w in toxicity.tokens(documents[r["doc_id"]]["text"]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc(r["doc_id"], 5) == 0)


def planted(spark, path):
    """Texts that mention groups, and the ids of neutral ones without a label. `Zorbs` are a group that no list has."""
    rng = random.Random(6)
    filler = [f"word{i}" for i in range(60)]
    # Toxic texts mention some groups, neutral ones mostly others of the same kinds.
    groups, others = ["muslims", "frauen", "zorbs"], ["christians", "jews", "männer"]
    docs, labels, neutral = [], [], []
    frames = [("all", "are"), ("the", "here"), ("many", "live"), ("some", "came"), ("those", "went")]

    def text(group, insult):
        own = rng.sample(filler, 6)
        if group:
            a, b = rng.choice(frames)
            own[3:3] = [a, group, b]
        return " ".join([*own, *(["scum", "filth"] if insult else [])])

    for i in range(1200):
        toxic = i % 2
        group = rng.choice(groups if toxic or rng.random() < 0.1 else others) if rng.random() < 0.9 else None
        docs.append((i, text(group, toxic and rng.random() < 0.8)))
        labels.append((i, toxic))
    for i in range(5000, 5200):
        docs.append((i, text(groups[i % len(groups)], False)))
        neutral.append(i)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return neutral


def test_neutral_mentions_of_groups_are_not_flagged(spark, tmp_path, monkeypatch):
    neutral = set(planted(spark, str(tmp_path)))
    found = {}
    ours = toxicity.SWAP_PENALTY
    for penalty in (0.0, ours):
        monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
        rows = queries.op8_toxicity(spark, str(tmp_path)).collect()
        assert {r["n_swapped"] for r in rows} == {next(iter(rows))["n_swapped"]} and rows[0]["n_swapped"] > 300
        found[penalty] = sum(r["score"] for r in rows if r["doc_id"] in neutral) / len(neutral), sum(r["predicted"] for r in rows if r["doc_id"] in neutral)
    assert found[ours][1] < 0.5 * found[0.0][1] and found[ours][0] < found[0.0][0], found
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    _, terms = toxicity.learned(docs, labels, F.lit(True))
    assert any("zorbs" in kind and "muslims" in kind for kind in terms) and not any("word1" in kind for kind in terms)


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(known[r["doc_id"]], r["score"]) for r in queries.op8_toxicity(spark, sf).collect() if r["held_out"] and known.get(r["doc_id"]) is not None]
    bad, good = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    assert bad and good and sum(b > g for b in bad for g in good) >= 0.9 * len(bad) * len(good)
    assert sum(s >= 0.5 for s in good) <= 0.1 * len(good)


def test_labels_of_an_id_that_rows_share(spark):
    docs = spark.createDataFrame([(1, f"scum number {'abcdefgh'[i % 8]}") for i in range(3000)] + [(2, "a fine day")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    found = toxicity.sample(docs, labels, F.lit(True))
    assert len(found) == 9 and len({frozenset(own) for _, own, _ in found}) == 9


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i % 3])
def test_one_id_for_a_whole_hot_group(spark, ids):
    rows = [(ids(i), "same text" + " " * (i % 2)) for i in range(20_000)] + [(10**6 + i, f"text {i % 90}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed = exact_dedup.classes(docs)
    assert placed.count() == len(rows)
    most = placed.filter("sha = sha2('sametext', 256)").groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 1500
    got = exact_dedup.mark_duplicates(docs).drop("n_points").collect()
    assert sorted(map(tuple, got), key=str) == exact_classes(docs.collect())


def test_huge_texts_are_hashed_by_chunks_in_rows(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abé漢 \n") for _ in range(200_000))
    rows = [(1, body), (2, body + " "), (3, body + "x"), (3, body + "x"), (None, body), (4, "x" + body), (5, "short"), (6, "sh ort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = exact_dedup.with_fingerprints(docs, 1000).collect()
    assert len(given) == len(rows)
    for r in given:
        assert (r["given"] is None) if len(r["text"]) <= 1000 else bytes(r["given"]) == exact_dedup.fingerprint(exact_dedup.normalised(r["text"]))
    got = exact_dedup.mark_duplicates(docs).drop("n_points").collect()
    assert sorted(map(tuple, got), key=str) == exact_classes(docs.collect())


@pytest.mark.parametrize("least", [1000, 20])
def test_texts_that_share_a_fingerprint_are_told_apart(spark, least):
    rows = [(i, f"text {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = defaultdict(set)
    for r in exact_dedup.classes(docs, least=least, of=lambda body: b"\0" * 16).collect():
        found[bytes(r["fp"]), r["other"]].add(rows[r["doc_id"]][1])
    assert len(found) == 7 and all(len(v) == 1 for v in found.values())


def test_dictionary_of_one_id_of_long_texts_and_of_few(spark):
    same = spark.createDataFrame([(5, f"word{i % 400} and more of it") for i in range(6000)], "doc_id long, text string")
    long_ones = spark.createDataFrame([(i, f"word{i} " * 9000) for i in range(12)], "doc_id long, text string")
    few = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    for docs in (same, long_ones, few):
        assert token_store.train_dictionary(docs, path, 1, "<u2")
    assert token_store.train_dictionary(few.filter("doc_id > 1"), path, 1, "<u2") == b""


def test_positions_of_the_mix(spark, documents):
    """The curriculum by summing each source's schedule numerically."""
    plan = {r["doc_id"]: r for r in mixing.assign(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    order = sorted({r["source"] for r in documents.values()}, key=lambda s: (s is None, s or ""))
    for k, source in enumerate(order):
        own = sorted((hashlib.md5(f"mix|{d}".encode()).hexdigest(), d) for d, r in documents.items() if r["source"] == source)
        knots, start = mixing.SCHEDULES[k % 3], 0
        at, weight = zip(*knots, strict=True)
        grid = np.linspace(0, 1, 200_001)
        rate = np.interp(grid, at, weight)
        area = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2)))
        for _, d in own:
            r = plan[d]
            for n, t in enumerate(r["positions"]):
                due = (start + r["source_size"] * n) / r["target"]
                assert t == pytest.approx(np.interp(due * area[-1], area, grid), abs=1e-4)
            start += r["size"]
