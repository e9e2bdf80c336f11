"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are hashed, and each digest is added to one cell in each of three tables; a cell
holds the count, the xor of digests and the xor of their check sums. Sketches of two versions
subtract cell by cell: what they share cancels, and peeling the cells that hold one digest recovers
the digests that differ, by side. If peeling gets stuck, larger sketches are compared, until it ends.
From the sizes and the differences follows the Jaccard likeness of the two sets.

A paragraph is a line, cut after sentences; a stretch of over LONGEST characters without one is cut
after words that a hash picks. The n-th occurrence of a paragraph has a digest of its own.

Defined results: a null text counts as empty, and two empty texts are alike (1). The next document
in ascending doc_id comes after a null doc_id, which comes first; equal doc_ids follow one another in
the order of their texts' hashes; a single document is its own next. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare

#: Cells of a fingerprint, three tables of a third each, and by how much a retry is larger.
CELLS, GROWTH = 24, 4
LONGEST = 320
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"\S*\s*")
MASK = (1 << 64) - 1


def paragraphs(text: str) -> list[str]:
    out = []
    for part in SENTENCE.findall(text):
        if len(part) <= LONGEST:
            out.append(part.strip())
            continue
        piece = ""
        for word in WORD.findall(part):
            piece += word
            if len(piece) > 64 and xxhash.xxh32_intdigest(word.strip()) % 8 == 0:
                out.append(piece.strip())
                piece = ""
        out.append(piece.strip())
    return [p for p in out if p]


def digests(text: str) -> list[int]:
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, -1) + 1
        d = xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"))
        out.append(d if not n else check(d ^ n) << 32 | check(d + n * 0x9E3779B97F4A7C15 & MASK))
    # Two of one kind would cancel in their cells and never peel.
    return list(dict.fromkeys(out))


def check(digest: int) -> int:
    x = (digest ^ digest >> 29) * 0xBF58476D1CE4E5B9 & MASK
    return x >> 32


class Sketch:
    """Cells of digests: `sums` holds digest << 32 | check sum, xored."""

    __slots__ = ("counts", "sums", "third")

    def __init__(self, cells: int, of: list[int] = ()) -> None:
        third = self.third = cells // 3
        counts, sums = self.counts, self.sums = [0] * (3 * third), [0] * (3 * third)
        for d in of:
            x = d << 32 | check(d)
            for p in (d % third, third + (d >> 20) % third, 2 * third + (d >> 41) % third):
                counts[p] += 1
                sums[p] ^= x

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(0)
        out.third = self.third
        out.counts = [a - b for a, b in zip(self.counts, other.counts, strict=True)]
        out.sums = [a ^ b for a, b in zip(self.sums, other.sums, strict=True)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """The digests left on either side, or None if cells remain. Empties the sketch."""
        third, counts, sums = self.third, self.counts, self.sums
        left: tuple[list[int], list[int]] = ([], [])
        todo = [p for p, n in enumerate(counts) if n in (1, -1)]
        while todo:
            p = todo.pop()
            n, x = counts[p], sums[p]
            d = x >> 32
            if n not in (1, -1) or x & 0xFFFFFFFF != check(d):
                continue
            left[n < 0].append(d)
            for q in (d % third, third + (d >> 20) % third, 2 * third + (d >> 41) % third):
                counts[q] -= n
                sums[q] ^= x
                if counts[q] in (1, -1):
                    todo.append(q)
        return None if any(counts) or any(sums) else left

    def text(self) -> str:
        packed = b"".join(struct.pack("<IQI", n & 0xFFFFFFFF, x >> 32, x & 0xFFFFFFFF) for n, x in zip(self.counts, self.sums, strict=True))
        return base64.b64encode(packed).decode()


class Version:
    """A text's digests and its sketches by size."""

    def __init__(self, text: str) -> None:
        self.digests = digests(text)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, cells: int) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch(cells, self.digests)
        return self.sketches[cells]

    def fingerprint(self) -> str:
        return f"{len(self.digests)}:{self.sketch(CELLS).text()}"


def difference(a: Version, b: Version) -> tuple[list[int], list[int]]:
    """Digests that only a has and that only b has."""
    cells = CELLS
    while cells < abs(len(a.digests) - len(b.digests)):
        cells *= GROWTH
    while True:
        found = a.sketch(cells).minus(b.sketch(cells)).peel()
        if found is not None:
            return found
        cells *= GROWTH


def likeness(a: Version, b: Version) -> float:
    only_a, only_b = difference(a, b)
    union = len(a.digests) + len(only_b)
    return (len(a.digests) - len(only_a)) / union if union else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many characters of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed
    (paragraph digests that the edit removed or added): one row for each document.

    Documents are dealt to ranges of doc_id whose bounds are quantiles; the first document of a range
    is also sent to the end of the range before, so that each task has every successor it needs.
    """
    spark = docs.sparkSession
    prepare(spark)
    first = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(first)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * partitions(spark)
    bounds = sorted({int(x) for x in keyed.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)})

    def placed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for batch in source:
            for key in batch["key"].to_pylist():
                at = bisect_left(bounds, key)
                if key < low.get(at, key + 1):
                    low[at] = key
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(low.keys(), pa.int32()), pa.array(low.values(), pa.int64())], names=["range", "low"])

    lows = {r["range"]: r["low"] for r in keyed.select("key").mapInArrow(placed, "range int, low long").groupBy("range").agg(F.min("low").alias("low")).collect()}
    ranges = sorted(lows)
    # The range that each range's first document closes; the very first closes the last range.
    closes = {lows[r]: ranges[k - 1] for k, r in enumerate(ranges)}

    def dealt(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys = batch["key"].to_pylist()
            own = [bisect_left(bounds, k) for k in keys]
            lent = [i for i, k in enumerate(keys) if k in closes]
            take = pa.array([*range(len(keys)), *lent], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(own + [closes[keys[i]] for i in lent], pa.int32()), pa.array([0] * len(keys) + [1] * len(lent), pa.int32()), *(batch[c].take(take) for c in ("doc_id", "key", "text"))], names=["range", "lent", "doc_id", "key", "text"])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changed"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def compared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in source:
            out = []
            for where, lent, doc, text in zip(*(batch[c].to_pylist() for c in ("range", "lent", "doc_id", "text")), strict=True):
                if where != at:
                    at, last = where, None
                elif last is None:
                    continue  # further rows of the document that closes the range
                own = Version(text)
                if last is not None:
                    doc_before, text_before, before = last
                    new_text = edited(text_before, text)
                    new = Version(new_text)
                    lost, won = difference(before, new)
                    union = len(before.digests) + len(won)
                    near = (len(before.digests) - len(lost)) / union if union else 1.0
                    out.append((doc_before, len(text_before), hashlib.sha256(new_text.encode("utf-8", "surrogatepass")).hexdigest(), before.fingerprint(), new.fingerprint(), near, likeness(before, own), len(lost) + len(won)))
                last = None if lent else (doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = keyed.mapInArrow(dealt, "range int, lent int, doc_id long, key long, text string")
    rows = rows.repartition(partitions(spark), "range").sortWithinPartitions("range", "lent", "key", F.xxhash64("text"))
    return rows.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed long")
