"""Removal of repeated passages, by suffix arrays.

A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a document before, or
earlier in its own. Strings are judged on the input and never cross documents.

1.  Every window has an anchor that depends on its bytes alone (see `anchors`), and windows in a row
    with one anchor form a span. Spans are dealt by their anchor. A span whose bytes stood before, in
    full, goes; one whose anchor occurs in no other bytes stays; the rest are open. In each batch
    only the first span of its kind is sent on, and of an anchor that has many kinds in one batch
    only the fact that it has: the largest number of rows for an anchor is in the number of batches.
2.  The bytes of open spans are dealt by anchor, and a suffix array of each group's spans
    (`suffix_array`) brings equal windows together: all but the first go. Spans of an anchor with
    more than GROUP kinds go through suffix arrays in blocks, and the first windows of each block,
    dealt by digest, meet those of the others.
3.  What goes is gathered by document.

Only spans, open bytes and intervals are shuffled besides the texts, which are shuffled once by
document and used for the second and the last step.

Defined results: a null text counts as empty; documents are in the order of doc_id, a null one last;
rows that share a doc_id are in the order of a hash of their texts, and rows that repeat are judged
alike, as one; a text shorter than a window keeps all its bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import GRAM, WINDOW
from .common import durable, partitions, prepare
from .suffix_array import suffix_array

#: Bytes of text that one batch of spans comes from, and buckets that they are dealt to; with more
#: buckets, batches grow alike, so that a bucket's share of a batch stays worth a row.
BATCH_BYTES, BUCKETS, MOST_BUCKETS = 16 << 20, 4096, 1 << 16
#: Kinds of spans of one anchor that a batch sends on, and that one suffix array takes; spans that go
#: through one array together, no fewer than GROUP.
SENT, GROUP = 8, 64
BLOCK = 256
#: Windows after which a task hands on what it has settled.
HELD = 400_000
HALF = (WINDOW - GRAM) // 2
PARTS = 256
LAST = (1 << 63) - 1

KIND = np.dtype([("key", "<u8"), ("bytes", "<u8"), ("doc", "<i8"), ("text", "<u8"), ("start", "<u4"), ("count", "u1"), ("place", "u1"), ("many", "u1")])
OPEN = np.dtype([("key", "<u8"), ("start", "<u4"), ("count", "u1"), ("place", "u1"), ("hot", "u1")])
FIRST = np.dtype([("digest", "S16"), ("doc", "<i8"), ("text", "<u8"), ("start", "<u4")])
#: What rows hold: spans or first windows on their way; what goes; what is open.
SPANS, GOES, ISOPEN = 0, 1, 2
FACTS = "bucket int, doc long, text_key long, what int, payload binary"
FACT_NAMES = ["bucket", "doc", "text_key", "what", "payload"]


def facts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FACT_NAMES)


def runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Intervals as a union of disjoint ones, in order, as u4 pairs."""
    order = np.argsort(starts, kind="stable")
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.append(True, starts[1:] > upto[:-1]))
    return np.stack([starts[cut], upto[np.append(cut[1:], len(starts)) - 1]], 1).astype("<u4")


def packed(rows: np.ndarray) -> bytes:
    """Rows column by column, documents as differences, compressed."""
    columns = [np.diff(rows["doc"], prepend=0) if n == "doc" else rows[n] for n in rows.dtype.names]
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def unpacked(body: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(body)
    out, at = np.zeros(len(raw) // kind.itemsize, kind), 0
    for n in kind.names:
        size = len(out) * kind[n].itemsize
        column = np.frombuffer(raw, kind[n], len(out), at)
        out[n] = np.cumsum(column) if n == "doc" else column
        at += size
    return out


def later_places(rows: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which rows have another place than the first of theirs; fresh: which rows are first. Rows with
    its very place come from rows of the table that repeat."""
    place = np.stack([rows["doc"].view(np.uint64), rows["text"], rows["start"].astype(np.uint64)], 1)
    return (place != place[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]).any(1)


def opened(rows: np.ndarray, hot) -> np.ndarray:
    out = np.zeros(len(rows), OPEN)
    for n in ("key", "start", "count", "place"):
        out[n] = rows[n]
    out["hot"] = hot
    return out


def whole_spans(rows: np.ndarray) -> np.ndarray:
    start = rows["start"].astype(np.int64)
    return np.stack([start, start + rows["count"] + (WINDOW - 1)], 1)


def by_document(doc: np.ndarray, text: np.ndarray, rows: np.ndarray, what: int, buckets: int) -> list[tuple]:
    """A fact for each document: rows are (n, 2) intervals, or OPEN."""
    order = np.lexsort((text, doc))
    doc, text, rows = doc[order], text[order], rows[order]
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])))
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
        own = rows[a:b]
        payload = own.tobytes() if what == ISOPEN else runs(own[:, 0], own[:, 1]).tobytes()
        out.append(((int(doc[a]) ^ int(text[a]) & 0x7FFFFFFF) % buckets, int(doc[a]), int(text[a : a + 1].view(np.int64)[0]), what, payload))
    return out


def spans_of(texts: list[tuple[int, int, bytes]]) -> Iterator[np.ndarray]:
    """KIND rows of (doc, text hash, bytes), in the order of the texts."""
    step = anchors.PIECE - 2 * WINDOW
    pieces: list[tuple[int, int, int, bytes]] = []
    held = 0

    def made() -> np.ndarray:
        bounds = np.concatenate(([0], np.cumsum([len(p[3]) for p in pieces])))
        which, start, count, place, key, whole = anchors.spans(b"".join(p[3] for p in pieces), bounds)
        out = np.zeros(len(start), KIND)
        out["key"], out["bytes"], out["count"], out["place"] = key, whole, count, place
        out["doc"] = np.array([p[0] for p in pieces], np.int64)[which]
        out["text"] = np.array([p[1] for p in pieces], np.int64).view(np.uint64)[which]
        out["start"] = start - bounds[which] + np.array([p[2] for p in pieces])[which]
        return out

    for doc, text, body in texts:
        for at in range(0, max(1, len(body) - WINDOW + 1), step):
            piece = body[at : at + step + WINDOW - 1]
            if held + len(piece) > anchors.PIECE:
                yield made()
                pieces, held = [], 0
            pieces.append((doc, text, at, piece))
            held += len(piece)
    if pieces:
        yield made()


def sharing(rows: np.ndarray) -> np.ndarray:
    """Indices of the rows whose key others have too, by key, bytes and place."""
    order = np.argsort(rows["key"])
    same = rows["key"][order][1:] == rows["key"][order][:-1]
    at = order[np.append(same, False) | np.append(False, same)]
    own = rows[at]
    return at[np.lexsort((own["start"], own["text"], own["doc"], own["bytes"], own["key"]))]


def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: which begin a key, which begin a kind, and the number of their key."""
    new_key = np.append(True, rows["key"][1:] != rows["key"][:-1])
    new_kind = new_key | np.append(True, rows["bytes"][1:] != rows["bytes"][:-1])
    return new_key, new_kind, np.cumsum(new_key) - 1


def read_spans(buckets: int):
    """Step 1 on texts: facts that hold within the batch, and spans for others to judge."""

    def judged(texts: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([*spans_of(texts)])
        if not len(rows):
            return
        out: list[tuple] = []
        send = np.ones(len(rows), bool)
        at = sharing(rows)
        if len(at):
            own = rows[at]
            new_key, new_kind, group = firsts(own)
            if (again := ~new_kind).any():
                out += by_document(own["doc"][again], own["text"][again], whole_spans(own[again]), GOES, buckets)
            many = np.bincount(group[new_kind])[group] > SENT
            if (hot := new_kind & many).any():
                out += by_document(own["doc"][hot], own["text"][hot], opened(own[hot], 1), ISOPEN, buckets)
            # Of an anchor with many kinds only its first row goes on, as a sign.
            send[at] = new_kind & (~many | new_key)
            rows["many"][at[many & new_key]] = 1
        sent = rows[send]
        bucket = (sent["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sent, bucket = sent[order], bucket[order]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        out += [(int(bucket[a]), None, None, SPANS, packed(sent[a:b])) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sent)], strict=True)]
        for k in range(0, len(out), 4096):
            yield facts(out[k : k + 4096])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size, most = 0, BATCH_BYTES * max(1, buckets // BUCKETS)
        for batch in source:
            for doc, key, text in zip(*(batch[c].to_pylist() for c in ("doc", "text_key", "text")), strict=True):
                if (doc, key) not in held and len(text) * 4 >= WINDOW:
                    held[doc, key] = body = text.encode("utf-8", "surrogatepass")
                    size += len(body)
            if size >= most:
                yield from judged([(*k, v) for k, v in held.items()])
                held, size = {}, 0
        if held:
            yield from judged([(*k, v) for k, v in held.items()])

    return run


def judge_spans(buckets: int):
    """Step 1 on dealt spans: facts; facts on their way pass through."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in source:
            dealt = np.array(batch["what"]) == SPANS
            got += [unpacked(p, KIND) for p in batch["payload"].filter(pa.array(dealt)).to_pylist()]
            if not dealt.all():
                yield batch.filter(pa.array(~dealt))
        if not got:
            return
        rows = np.concatenate(got)
        rows = rows[sharing(rows)]
        if not len(rows):
            return
        _, new_kind, group = firsts(rows)
        sign = rows["many"] == 1
        size, out = np.bincount(group[new_kind]), []
        several = (size > 1) | (np.bincount(group, sign) > 0)
        hot = (size > GROUP) | (np.bincount(group, sign) > 0)
        if (again := later_places(rows, new_kind) & ~sign).any():
            own = rows[again]
            out += by_document(own["doc"], own["text"], whole_spans(own), GOES, buckets)
        if (left := new_kind & several[group] & ~sign).any():
            own = rows[left]
            out += by_document(own["doc"], own["text"], opened(own, hot[group][left]), ISOPEN, buckets)
        for at in range(0, len(out), 4096):
            yield facts(out[at : at + 4096])

    return run


OPEN_SPANS = "key long, part int, doc long, text_key long, start long, place int, hot boolean, body binary"
OPEN_NAMES = ["key", "part", "doc", "text_key", "start", "place", "hot", "body"]


def open_spans(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open spans, of documents joined with their facts."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in source:
        rows = []
        for doc, text_key, text, payloads in zip(*(batch[c].to_pylist() for c in ("doc", "text_key", "text", "payloads")), strict=True):
            body = text.encode("utf-8", "surrogatepass")
            part = (doc ^ text_key) % PARTS
            for key, start, count, place, hot in {x for p in payloads for x in np.frombuffer(p, OPEN).tolist()}:
                rows.append((key - (1 << 64) if key >> 63 else key, part if hot else 0, doc, text_key, start, place, bool(hot), body[start : start + count + WINDOW - 1]))
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 4096], strict=True), kinds, strict=True)], names=OPEN_NAMES)


def promising(bodies: list[bytes], places: list[int]) -> list[int]:
    """Spans that can share a window with another: equal windows have their anchor at one place, and
    agree in the anchor and HALF bytes before or behind it."""
    sides = []
    for body, place in zip(bodies, places, strict=True):
        head = body[place - HALF : place + GRAM] if place >= HALF else None
        tail = body[place : place + GRAM + HALF] if len(body) - place >= GRAM + HALF else None
        sides.append((head, tail))
    heads, tails = Counter(h for h, _ in sides), Counter(t for _, t in sides)
    return [k for k, (h, t) in enumerate(sides) if h is not None and heads[h] > 1 or t is not None and tails[t] > 1]


def repeats(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    """(span, offset) of every window that equals one of an earlier span, or an earlier one of its own."""
    text: list[int] = []
    owner: list[int] = []
    begins = []
    for k, body in enumerate(bodies):
        begins.append(len(text))
        text += body
        text.append(256 + k)
        owner += [k] * (len(body) - WINDOW + 1)
        owner += [-1] * WINDOW
    flat = b"\0".join(bodies)
    last, lowest = None, 0
    # Equal windows stand together: the lowest stays, whichever comes first in the array.
    for p in suffix_array(text):
        k = owner[p]
        if k < 0:
            continue
        window = flat[p : p + WINDOW]
        if window == last:
            p, lowest = max(p, lowest), min(p, lowest)
            k = owner[p]
            yield k, p - begins[k]
        else:
            last, lowest = window, p


class Settled:
    """What goes, and the first windows of hot spans, gathered over the blocks of a task."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.gone: list[tuple[int, int, int, int]] = []
        self.first: list[tuple[bytes, int, int, int]] = []

    def block(self, rows: list[tuple]) -> None:
        _, _, docs, texts, starts, places, hots, bodies = zip(*rows, strict=True)
        pick = range(len(rows)) if hots[0] else promising(bodies, places)
        again: set[tuple[int, int]] = set()
        if len(pick) > 1:
            for span, offset in repeats([bodies[k] for k in pick]):
                k = pick[span]
                again.add((k, offset))
                self.gone.append((docs[k], texts[k], starts[k] + offset, starts[k] + offset + WINDOW))
        if hots[0]:
            for k, body in enumerate(bodies):
                text = texts[k] & 0xFFFFFFFFFFFFFFFF
                for offset in range(len(body) - WINDOW + 1):
                    if (k, offset) not in again:
                        self.first.append((hashlib.blake2b(body[offset : offset + WINDOW], digest_size=16).digest(), docs[k], text, starts[k] + offset))

    def rows(self) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        if self.gone:
            doc, text, start, end = np.array(self.gone, np.int64).T
            out += by_document(doc, text.view(np.uint64), np.stack([start, end], 1), GOES, self.buckets)
        if self.first:
            first = np.array(self.first, FIRST)
            bucket = np.frombuffer(first["digest"].tobytes(), "<u4")[::4] % self.buckets
            order = np.argsort(bucket, kind="stable")
            first, bucket = first[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out += [(int(bucket[a]), None, None, SPANS, packed(first[a:b])) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(first)], strict=True)]
        self.gone, self.first = [], []
        for at in range(0, len(out), 4096):
            yield facts(out[at : at + 4096])


def settle(buckets: int):
    """Step 2 on open spans, sorted by key, part and place."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = Settled(buckets), []
        for batch in source:
            for row in zip(*(batch[c].to_pylist() for c in OPEN_NAMES), strict=True):
                if block and row[:5] == block[-1][:5]:
                    continue  # of a row that repeats
                if block and (row[:2] != block[0][:2] or len(block) >= BLOCK):
                    held.block(block)
                    block = []
                block.append(row)
            if len(held.gone) + len(held.first) >= HELD:
                yield from held.rows()
        if block:
            held.block(block)
        yield from held.rows()

    return run


def meet(buckets: int):
    """Step 2 on first windows of blocks: all but the first of equal ones go; facts pass through."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in source:
            dealt = np.array(batch["what"]) == SPANS
            got += [unpacked(p, FIRST) for p in batch["payload"].filter(pa.array(dealt)).to_pylist()]
            if not dealt.all():
                yield batch.filter(pa.array(~dealt))
        if not got:
            return
        rows = np.concatenate(got)
        rows = rows[np.lexsort((rows["start"], rows["text"], rows["doc"], rows["digest"]))]
        again = later_places(rows, np.append(True, rows["digest"][1:] != rows["digest"][:-1]))
        if again.any():
            own = rows[again]
            start = own["start"].astype(np.int64)
            out = by_document(own["doc"], own["text"], np.stack([start, start + WINDOW], 1), GOES, buckets)
            for at in range(0, len(out), 4096):
                yield facts(out[at : at + 4096])

    return run


def cut_out(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        rows = []
        for doc, text, payloads in zip(*(batch[c].to_pylist() for c in ("doc", "text", "payloads")), strict=True):
            body = text.encode("utf-8", "surrogatepass")
            gone = np.concatenate([np.frombuffer(p, "<u4").reshape(-1, 2) for p in payloads]).astype(np.int64) if payloads else np.zeros((0, 2), np.int64)
            gone = runs(gone[:, 0], gone[:, 1]).tolist() if len(gone) else []
            kept, at = [], 0
            for a, b in gone:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            rows.append((None if doc == LAST else doc, len(body), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest(), [{"from": a, "to": b} for a, b in gone]))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array<struct<from, to>>, in bytes):
    one row for each document."""
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(spark)
    buckets = min(n, MOST_BUCKETS)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    # Texts are told apart by their hashes only where doc_ids don't do.
    alone = docs.groupBy(doc).count().filter("count > 1").isEmpty()
    text_key = F.lit(0).cast("long") if alone else F.xxhash64("text")
    base = docs.select(doc.alias("doc"), text_key.alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = base.mapInArrow(read_spans(buckets), FACTS).repartition(n, "bucket")
    known = durable(dealt.mapInArrow(judge_spans(buckets), FACTS))
    still = known.filter(F.col("what") == ISOPEN).groupBy("doc", "text_key").agg(F.collect_list("payload").alias("payloads"))
    bodies = base.join(still, ["doc", "text_key"]).mapInArrow(open_spans, OPEN_SPANS)
    bodies = bodies.repartition(n, "key", "part").sortWithinPartitions("key", "part", "doc", "text_key", "start")
    settled = bodies.mapInArrow(settle(buckets), FACTS).repartition(n, "bucket").mapInArrow(meet(buckets), FACTS)
    gone = known.filter(F.col("what") == GOES).unionByName(settled).groupBy("doc", "text_key").agg(F.collect_list("payload").alias("payloads"))
    return base.join(gone, ["doc", "text_key"], "left").mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<`from`: bigint, `to`: bigint>>")
