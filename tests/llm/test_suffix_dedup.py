from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from orrery.llm import anchors, suffix_dedup
from orrery.llm.suffix_array import suffix_array

W = anchors.WINDOW


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(4000):
        t = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(0, 25))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows):
    """rows: (doc_id, text), doc_ids in ascending order."""
    seen, out = set(), []
    for doc, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for i in range(len(body) - W + 1):
            window = body[i : i + W]
            if window in seen:
                gone[i : i + W] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(body, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [prose(rng.randrange(20, 120)) for _ in range(6)]
    common = prose(60)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1] or ""
            if rng.random() < 0.5 and len(text) > 10:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice(vocabulary) + text[at + 3 :]
        elif kind < 0.25:
            text = rng.choice(["", None, "a" * rng.randrange(50, 400), "ab" * 150, "line of text\n" * 40])
        else:
            text = " ".join(rng.choice([prose(rng.randrange(5, 60)), rng.choice(shared), common]) for _ in range(rng.randrange(1, 5)))
        rows.append((i * 3, text))
    return rows


def result(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("sent", "group", "block"), [(8, 64, 256), (1, 2, 5), (2, 3, 3)])
def test_equals_brute_force(spark, monkeypatch, sent, group, block):
    rng = random.Random(sent)
    rows = corpus(rng, 250)
    want = brute(rows)
    shuffled = rng.sample(rows, len(rows))
    for name, value in (("SENT", sent), ("GROUP", group), ("BLOCK", block), ("BATCH_BYTES", 20_000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    # Workers import the module anew, so the functions are also run here, over the same steps.
    assert local(shuffled) == want
    if sent == 8:
        assert result(suffix_dedup.remove_repeats(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(4))) == want


def local(rows, buckets=3):
    """The steps in this process, with several batches and buckets."""
    import pyarrow as pa

    s = suffix_dedup
    base = pa.RecordBatch.from_pydict({"doc": [d for d, _ in rows], "text_key": [0] * len(rows), "text": [t or "" for _, t in rows]})
    batches = [base.slice(i, 40) for i in range(0, len(rows), 40)]
    dealt = [r for b in s.read_spans(buckets)(iter(batches)) for r in b.to_pylist()]
    schema = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("text_key", pa.int64()), ("what", pa.int32()), ("payload", pa.binary())])

    def through(fn, rows):
        out = []
        for k in range(buckets):
            own = [r for r in rows if r["bucket"] == k]
            if own:
                out += [r for b in fn(buckets)(iter([pa.RecordBatch.from_pylist(own, schema)])) for r in b.to_pylist()]
        return out

    known = through(s.judge_spans, dealt)
    payloads = lambda what, facts: {d: [r["payload"] for r in facts if r["doc"] == d and r["what"] == what] for d, _ in rows}
    still = payloads(s.ISOPEN, known)
    joined = pa.RecordBatch.from_pydict({**{n: base[n] for n in base.schema.names}, "payloads": pa.array([still[d] for d, _ in rows], pa.list_(pa.binary()))})
    spans = [r for b in s.open_spans(iter([joined])) for r in b.to_pylist()]
    spans.sort(key=lambda r: (r["key"], r["part"], r["doc"], r["start"]))
    first = next(iter(s.open_spans(iter([joined]))), None)
    settled = [] if first is None else [r for b in s.settle(buckets)(iter([pa.RecordBatch.from_pylist(spans, first.schema)])) for r in b.to_pylist()]
    gone = payloads(s.GOES, [r for r in known if r["what"] == s.GOES] + through(s.meet, settled))
    final = pa.RecordBatch.from_pydict({**{n: base[n] for n in base.schema.names}, "payloads": pa.array([gone[d] for d, _ in rows], pa.list_(pa.binary()))})
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for b in s.cut_out(iter([final])) for r in b.to_pylist())


def test_long_documents_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 5000)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = [(1, "".join(rng.choice("abcdefgh ") for _ in range(9000)) + passage), (2, "x" + passage + "y" * 12_000), (3, passage[50:3000])]
    assert local(rows) == brute(rows)


def test_odd_texts(spark, odd, empty):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(odd).collect()}
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()
    assert got[None]["n_removed"] == got[5]["n_removed"] == got[2]["n_bytes"] == 0
    # All but the first of the long run, and all but the first period of the words.
    assert got[8]["n_removed"] > 340_000
    assert suffix_dedup.remove_repeats(empty).count() == 0
