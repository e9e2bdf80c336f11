"""Resampling towards a target distribution: documents drawn by hashed features' likelihood ratios.

Features are runs of one and two words in hashed buckets. Where a bucket is more frequent in the target
than in the corpus its gain is positive; a document's weight is the mean gain of its features, and the
draw without replacement takes the highest weights after Gumbel noise that a hash of the id gives.

The bytes of an Arrow batch are read as one array. A look-up table classifies and lower-cases them,
words start and end where neighbouring classes differ or a document does, and table-driven CRCs
advance over all words in step: one byte of every word that has one left, from the fresh state for
single words, from the state behind the word before and a blank for pairs. Texts are taken in blocks of
BLOCK bytes that end between words, so memory follows a block (or the longest word), never a text.

Counts of buckets are added up in each task, then by bucket: BUCKETS rows at most reach the driver and
travel to the tasks, whatever the corpus. Ranks come from a range sort and the ranges' row counts.

Defined results: a null text has no words, weight 0 and no rank; a null id hashes as `7:` and comes
after others of its score; repeated rows are documents of their own, whose ties are broken by where they
are read; an empty table gives no rows, and an empty target the gains of a target without features.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions, prepare, record

BUCKETS = 10_000
BLOCK = 1 << 22
#: Steps that all words take together; what longer ones have left is read one by one.
STEPS = 48
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
START, ALL = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """Of the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


TABLE = crc_table()


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after data[start : start + size], all of them a byte at a time; data in lower case."""
    order = np.argsort(-size, kind="stable")
    at, left, own = start[order], size[order], state[order]
    open_at = np.searchsorted(-left, -np.arange(min(STEPS, int(left[0]) if len(left) else 0)), side="left")
    for j, n in enumerate(open_at.tolist()):
        own[:n] = TABLE[(own[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ own[:n] >> np.uint32(8)
    for i in range(int(np.searchsorted(-left, -STEPS, side="left"))):
        rest = data[at[i] + STEPS : at[i] + left[i]]
        own[i] = zlib.crc32(rest, int(own[i] ^ ALL)) ^ 0xFFFFFFFF
    out = np.empty_like(own)
    out[order] = own
    return out


def blocks(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Pieces of about `size` bytes that end behind a byte between words."""
    low = 0
    while low < len(data):
        high = min(len(data), low + size)
        if high < len(data):
            apart = np.flatnonzero(~WORD[data[low:high]])
            while not len(apart) and high < len(data):
                low_edge, high = high, min(len(data), high + size)
                apart = np.flatnonzero(~WORD[data[low_edge:high]]) + (low_edge - low)
            if len(apart) and high < len(data):
                high = low + int(apart[-1]) + 1
        yield low, high
        low = high


def features(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of a column of texts: the row of each word; the row, and the bucket, of each feature."""
    column = texts.cast(pa.binary()).cast(pa.large_binary())
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:  # whatever stands behind a null isn't read
        bodies = [t or b"" for t in column.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bodies], dtype=np.int64)))
        values = b"".join(bodies)
    every = np.frombuffer(values or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    last_state, last_row = START, -1
    for low, high in blocks(every, size):
        data = LOWER[every[low:high]]
        inside = WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets[(offsets >= low) & (offsets <= high)] - low] = True
        begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        if not len(begin):
            continue
        row = np.searchsorted(offsets, begin + low, side="right") - 1
        single = advance(np.full(len(begin), START, np.uint32), data, begin, end - begin)
        before, row_before = np.concatenate(([last_state], single[:-1])).astype(np.uint32), np.concatenate(([last_row], row[:-1]))
        paired = np.flatnonzero(row == row_before)
        gap = TABLE[(before[paired] ^ np.uint32(32)) & np.uint32(0xFF)] ^ before[paired] >> np.uint32(8)
        double = advance(gap, data, begin[paired], (end - begin)[paired])
        last_state, last_row = single[-1], int(row[-1])
        yield row, np.concatenate((row, row[paired])), (np.concatenate((single, double)) ^ ALL).astype(np.int64) % BUCKETS


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    prepare(docs.sparkSession)

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in source:
            for _, _, bucket in features(batch["text"]):
                total += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield record(["bucket", "n"], [found, total[found]], [pa.int32(), pa.int64()])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target, both smoothed by one."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))
    return np.array([math.floor(1000.0 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row for each row of docs."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def weighed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for word, row, bucket in features(batch["text"]):
                words += np.bincount(word, minlength=batch.num_rows)
                n += np.bincount(row, minlength=batch.num_rows)
                # Sums of whole numbers below 2**53 are exact in doubles.
                total += np.bincount(row, gain[bucket], batch.num_rows).astype(np.int64)
            weight = total // np.maximum(n, 1)
            score = weight + np.array([noise(d) for d in batch["doc_id"].to_pylist()], np.int64)
            yield record(names, [batch["doc_id"], words, n, weight, score], [pa.int64()] * 5)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weighed, ", ".join(f"{c} long" for c in names))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with rank: 1, 2, 3 by score and doc_id for the share that is drawn of those with enough
    words, null for all others."""
    spark = weighed.sparkSession
    rows, names = durable(weighed), [*weighed.columns, "rank"]
    enough = F.col("n_words") >= least_words
    # The last key spreads rows that tie in all others; it is fixed, since the rows are kept.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    ranged = rows.filter(enough).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = durable(ranged.withColumn("range", F.spark_partition_id()))
    # A row for each range: as many as shuffle partitions. A range's rows stay together and in order.
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    most, bases, total = sum(sizes.values()) * percent // 100, {}, 0
    for k in sorted(sizes):
        bases[k], total = total, total + sizes[k]

    def numbered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = -1, 0
        for batch in source:
            if batch.num_rows:
                own = batch["range"][0].as_py()
                if own != current:
                    current, count = own, bases[own]
                rank = np.arange(count + 1, count + 1 + batch.num_rows)
                count += batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:-1]), pa.array(rank, pa.int64(), mask=rank > most)], names=names)

    drawn = ranged.drop("tie").mapInArrow(numbered, ", ".join(f"{c} long" for c in names))
    return drawn.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs, drawn towards the texts of `target`."""
    return draw(weigh(docs, gains(bucket_counts(docs), bucket_counts(target))))
