"""Exact duplicates by composable polynomial fingerprints.

A text is a polynomial in 256 whose coefficients are its bytes, and its fingerprint is the value
modulo a large safe prime. Fingerprints compose: for a text A followed by B,

    H(A B) = H(A) * 256**len(B) + H(B)   (mod p)

so chunks are hashed independently, those of huge texts in tasks of their own, and combined afterwards. Equal
fingerprints only nominate: the texts themselves are then compared chunk by chunk, and texts that
share a fingerprint without being equal are told apart.

Defined results: a null text counts as empty; empty texts are equal to each other; a null doc_id
sorts after all others; repeated rows are members of one group, and rows that tie with the row that
stays in every respect are marked as kept too. Extra columns are ignored by `mark_duplicates` and
kept as they are by `drop_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, durable, only, partitions, prepare, record

#: A safe prime of 127 bits, (MODULUS - 1) / 2 being prime too: 256 then has an order of at least
#: that half, so no two positions of a text share a weight.
MODULUS = (1 << 126) + 823
CHUNK = 1 << 16
#: Characters from which on a text is hashed in chunks that are rows of their own.
HUGE = 1 << 20
WHITE = b" \t\n\v\f\r"


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """(fingerprint, length) of one chunk."""
    return int.from_bytes(chunk, "big") % MODULUS, len(chunk)


def combine(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """Of a text from those of its two parts; associative, with (0, 0) as the neutral element."""
    return (left[0] * pow(256, right[1], MODULUS) + right[0]) % MODULUS, left[1] + right[1]


def fingerprint(data: bytes, chunk: int = CHUNK) -> bytes:
    """16 bytes. The length is mixed in, since leading zero bytes don't change the polynomial."""
    total = (0, 0)
    for at in range(0, len(data), chunk):
        total = combine(total, chunk_hash(data[at : at + chunk]))
    return finish(total)


def finish(total: tuple[int, int]) -> bytes:
    return ((total[0] + total[1] * 0x9E3779B97F4A7C15F39CC0605CEDC835) % MODULUS).to_bytes(16, "big")


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def equal_by_chunks(a: bytes, b: bytes, chunk: int = CHUNK) -> bool:
    if len(a) != len(b):
        return False
    left, right = memoryview(a), memoryview(b)
    return all(left[i : i + chunk] == right[i : i + chunk] for i in range(0, len(a), chunk))


def fingerprint_chunks(chunks: DataFrame) -> DataFrame:
    """For huge documents held as rows (doc_id, chunk_no, chunk binary): doc_id, fingerprint.

    Chunks are hashed wherever they are; only (chunk_no, hash, length) is shuffled, and combined in
    the order of chunk_no. A null chunk counts as empty.
    """
    prepare(chunks.sparkSession)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [chunk_hash(c or b"") for c in batch["chunk"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["chunk_no"].cast(pa.int64()), pa.array([h.to_bytes(16, "big") for h, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "chunk_no", "h", "n"])

    def combined(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for parts in batch["parts"].to_pylist():
            total = (0, 0)
            for p in parts:
                total = combine(total, (int.from_bytes(p["h"], "big"), p["n"]))
            out.append(finish(total))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "fingerprint"])

    parts = chunks.select("doc_id", "chunk_no", "chunk").mapInArrow(batches(hashed), "doc_id long, chunk_no long, h binary, n long")
    grouped = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "h", "n"))).alias("parts"))
    return grouped.mapInArrow(batches(combined), "doc_id long, fingerprint binary")


def with_fingerprints(docs: DataFrame, huge: int | None = HUGE) -> DataFrame:
    """doc_id, text, given: the fingerprint of texts of more than `huge` characters, from chunks that are
    rows of their own and hashed in parallel; null for the others, which are hashed where they are read,
    as all are where `huge` is None."""
    prepare(docs.sparkSession)
    none = F.lit(None).cast("binary").alias("given")
    if huge is None:
        return docs.select("doc_id", "text", none)
    long = F.coalesce(F.length("text"), F.lit(0)) > huge
    rows, short = docs.filter(long), docs.filter(~long).select("doc_id", "text", none)

    def numbered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + batch.num_rows), pa.int64()), batch["doc_id"], batch["text"]], names=["row", "doc_id", "text"])
            row += batch.num_rows

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                body = normalised(text)
                starts = range(0, max(1, len(body)), CHUNK)
                for first in range(0, len(starts), 64):
                    part = starts[first : first + 64]
                    yield record(["doc_id", "chunk_no", "chunk"], [[row] * len(part), range(first, first + len(part)), [body[at : at + CHUNK] for at in part]], [pa.int64(), pa.int64(), pa.binary()])

    rows = durable(rows.mapInArrow(numbered, "row long, doc_id long, text string"))
    chunks = rows.select("row", "text").mapInArrow(cut, "doc_id long, chunk_no long, chunk binary").repartition(partitions(docs.sparkSession), "doc_id", "chunk_no")
    found = fingerprint_chunks(chunks).select(F.col("doc_id").alias("row"), F.col("fingerprint").alias("given"))
    return short.unionByName(durable(rows.join(found, "row").drop("row")))


def hot_groups(docs: DataFrame, n: int, most: int = 5000, least: int = 1000, of: Callable[[bytes], bytes] = fingerprint) -> dict[bytes, tuple[int, int | None]]:
    """Fingerprints that hold over 1/most of all n rows (and over `least`): the number of parts to deal
    them to, and the doc_id whose text stands for them. At most `most` entries, however many rows.
    """

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        only(("texts",), object)
        given = batch["given"].to_pylist()
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([g or of(normalised(t)) for t, g in zip(batch["text"].to_pylist(), given, strict=True)], pa.binary())], names=["doc_id", "fp"])

    floor = max(least, n // most)
    groups = docs.mapInArrow(batches(hashed), "doc_id long, fp binary").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return {bytes(r["fp"]): (-(-r["n"] // floor) * 4, r["first"]) for r in groups.filter(F.col("n") > floor).collect()}


def spread(x: int) -> int:
    """32 bits that depend on all of x's lower 64."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 27)) * 0x94D049BB133111EB >> 32 & 0xFFFFFFFF


def classes(docs: DataFrame, least: int = 1000, of: Callable[[bytes], bytes] = fingerprint, huge: int = HUGE) -> DataFrame:
    """doc_id, n_points, fp, other, part, sha: equal normalised texts are those with equal (fp, other).

    Texts go to the task of their fingerprint, hot fingerprints to several tasks with a copy of the
    text that stands for them, and stream past that text in sorted order. A hot group's rows are dealt by
    doc_id and by how often a task has met it, so that rows of one id, or without one, are spread too. `other` is empty for a
    text that equals it, else the text's own digest. `of` is the fingerprint.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = docs.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest")).first()
    docs = with_fingerprints(docs, huge if (facts["longest"] or 0) > huge else None)
    hot = hot_groups(docs, facts["n"], least=least, of=of)
    names = ["fp", "part", "role", "doc_id", "n_points", "sha", "body"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def dealt(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(("texts",), object)
        # Of hot groups: what this task has sent as a reference, and how often it has met an id.
        sent: set[bytes] = set()
        met: Counter = Counter()
        for batch in source:
            rows = []
            for doc, text, given in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "given")), strict=True):
                body = normalised(text)
                fp, sha, part = given or of(body), hashlib.sha256(body).hexdigest(), 0
                if fp in hot:
                    parts, first = hot[fp]
                    if doc == first and fp not in sent:
                        sent.add(fp)
                        rows += [(fp, p, 0, doc, 0, sha, body) for p in range(parts)]
                    met[fp, doc] += 1
                    part = spread((doc or 0) * 0x9E3779B1 + met[fp, doc]) * parts >> 32
                rows.append((fp, part, 1, doc, len(text or ""), sha, body))
            if rows:
                yield record(names, list(zip(*rows, strict=True)), kinds)

    def compared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reference = None, b""
        for batch in source:
            out = []
            for fp, part, role, doc, points, sha, body in zip(*(batch[n].to_pylist() for n in names), strict=True):
                if (fp, part) != key:
                    key, reference = (fp, part), body
                if role:
                    out.append((doc, points, fp, "" if equal_by_chunks(body, reference) else sha, part, sha))
            if out:
                yield record(["doc_id", "n_points", "fp", "other", "part", "sha"], list(zip(*out, strict=True)), [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.string()])

    placed = docs.mapInArrow(dealt, "fp binary, part int, role int, doc_id long, n_points long, sha string, body binary")
    placed = placed.repartition(partitions(docs.sparkSession), "fp", "part").sortWithinPartitions("fp", "part", "role", "doc_id")
    return placed.mapInArrow(compared, "doc_id long, n_points long, fp binary, other string, part int, sha string")


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points: one row for each row of docs.

    Of equal texts the one with the most code points stays, then the one with the smallest doc_id.
    """
    rows = durable(classes(docs))
    last = F.lit(-(1 << 63)).cast("long")
    rank = F.struct("n_points", F.coalesce(-F.col("doc_id"), last).alias("minus_id"))
    # Rows meet their group by the part that they were dealt to, so that a hot group stays spread out.
    parts = rows.groupBy("fp", "other", "part").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("top"))
    groups = parts.groupBy("fp", "other").agg(F.sum("n").alias("group_size"), F.max("top").alias("best"))
    groups = parts.select("fp", "other", "part").join(groups, ["fp", "other"])
    groups = groups.withColumn("keep_id", F.when(F.col("best.minus_id") > last, -F.col("best.minus_id")))
    kept = (F.col("n_points") == F.col("best.n_points")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(groups, ["fp", "other", "part"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "n_points")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that tie in every respect, the
    one whose text sorts last."""
    kept = mark_duplicates(docs).filter("kept").groupBy("doc_id", "text_sha256", "n_points").agg(F.count(F.lit(1)).alias("ties"))
    kept = durable(kept).select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "text_sha256", "n_points", "ties")))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.sha2(F.translate(text, " \t\n\x0b\x0c\r", "").cast("binary"), 256)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (own == F.col("__text_sha256")) & (F.length(text) == F.col("__n_points"))
    staying = docs.join(kept, same)
    tied = staying.filter("__ties > 1").groupBy("__doc_id", "__text_sha256").agg(F.max_by(F.struct(*docs.columns), text).alias("__row"))
    return staying.filter("__ties = 1").select(*docs.columns).unionByName(tied.select("__row.*"))
