"""What filters do to one another: every order of them, step by step.

A document's failures are bits of a mask, and all that any order does to a part of the corpus can be
told from the counts of its mask cells, of which there are 2**k for k filters. The k! orders are
visited by plain changes, each a single swap of neighbours: a swap of the filters at steps i and i + 1
leaves what stands before i and what is kept after i + 1 as it was, so that only these two steps are
read from the cells again. Shapley values, summed over all orders, accumulate along the walk.

Texts are read once, where they are; a row of a few bytes for each goes on. Copies meet by a 256-bit
digest: the smallest doc_id of each is aggregated on the map side, and rows look for themselves in
(digest, doc_id), a key that no group of copies makes hot. Cells are aggregated on the map side too.

Defined results: a null text counts as empty; a null source is the part ''; a null doc_id is larger than
all others, and rows that share a doc_id and a text aren't copies of one another; a document is good
or toxic if any of its labels says so, and neither without a label or an id; an empty table has no
parts. Repeated rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, durable, prepare, record

#: The filters' letters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
CAPITALS, MARKS, INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))
COUNTS = ("n", "good", "toxic")
#: Values of the salt that spreads rows without an id where labels are looked up.
SPREAD = 1024


def text_mask(text: bytes) -> int:
    """Bits of the filters that look at a text alone: A few words, B repetitive, C capitals, D marks."""
    words = text.split()
    few, repetitive = len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    points, capitals = len(text.translate(None, INNER)), len(text) - len(text.translate(None, CAPITALS))
    return few | repetitive << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows that add up to the mask cells of each part."""
    prepare(docs.sparkSession)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([text_mask(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(batches(read), "doc_id long, part string, digest binary, mask int")
    rows = durable(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    # Of copies, those with the smallest id pass; the rest fail the last filter.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumnRenamed("digest", "of")
    own = (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))
    copy = F.when(F.col("of").isNull(), 1 << (len(FILTERS) - 1)).otherwise(0)
    rows = rows.join(first, own, "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD)) + 1).otherwise(0).alias("salt"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(f"__{c}") for c in ("quality", "toxic")))
    rows = rows.join(known.withColumn("__salt", F.lit(0).cast("long")), (F.col("doc_id") == F.col("__id")) & (F.col("salt") == F.col("__salt")), "left")
    return rows.select("part", "mask", "n", *((F.col("n") * F.coalesce(F.col(f"__{of}"), F.lit(0))).alias(name) for name, of in (("good", "quality"), ("toxic", "toxic"))))


def plain_changes(k: int) -> Iterator[int]:
    """The k! - 1 swaps, of what stands at i and i + 1, that visit all orders of k."""
    if k < 2:
        return
    inner, down = plain_changes(k - 1), True
    while True:
        # The last element walks through the others, who take a step of their own at each of its turns.
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down
        down = not down


def walk(cells: np.ndarray, filters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For cells (parts, 2**k, counts): the orders as visited; for each part, order and step the filter's
    number, kept, removed (of each count), redundant; and for each part and filter its Shapley sum."""
    k, mask = len(filters), np.arange(cells.shape[1])
    failing = [cells[:, mask >> f & 1 == 1, 0].sum(1) for f in range(k)]

    def step(before: int, f: int) -> np.ndarray:
        """kept, removed (by count) and redundant of a filter after the filters of the bits `before`."""
        removed = cells[:, (mask & before == 0) & (mask >> f & 1 == 1)].sum(1)
        kept = cells[:, mask & (before | 1 << f) == 0, 0].sum(1)
        return np.column_stack([np.full(len(cells), f), kept, removed, failing[f] - removed[:, 0]])

    order, orders, out = list(range(k)), [], []
    steps = [step((1 << i) - 1, i) for i in range(k)]
    shapley = np.zeros((len(cells), k), np.int64)
    swaps = plain_changes(k)
    while True:
        orders.append("".join(filters[f] for f in order))
        out.append(np.stack(steps, 1))
        for f, own in zip(order, steps, strict=True):
            shapley[:, f] += own[:, 2]
        at = next(swaps, None)
        if at is None:
            return orders, np.stack(out, 1), shapley
        order[at], order[at + 1] = order[at + 1], order[at]
        before = sum(1 << f for f in order[:at])
        steps[at], steps[at + 1] = step(before, order[at]), step(before | 1 << order[at], order[at + 1])


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For rows (part, mask, n, good, toxic), of which bit i of mask says that filters[i] fails: one row
    for each part, order of all filters, and step.

    kept, removed, redundant (failing, removed earlier), unique_fails (failing this filter only),
    good_lost and toxic_lost count documents of the part; shapley is the filter's removed over all orders.
    """
    prepare(rows.sparkSession)
    if not 1 <= len(filters) <= 8:
        raise ValueError("from one to eight filters, since all their orders are listed")
    cells = rows.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))
    # A row for each part, with 2**k cells at most.
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    k = len(filters)

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            parts, own = batch["part"].to_pylist(), batch["cells"].to_pylist()
            for low in range(0, len(parts), 16):
                names, table = parts[low : low + 16], np.zeros((len(parts[low : low + 16]), 1 << k, len(COUNTS)), np.int64)
                for i, found in enumerate(own[low : low + 16]):
                    for c in found:
                        table[i, c["mask"]] = [c[x] for x in COUNTS]
                orders, steps, shapley = walk(table, filters)
                f = steps[..., 0].reshape(len(names), -1)
                alone, of = table[:, [1 << i for i in range(k)], 0], np.repeat(np.arange(len(names)), f.shape[1])
                kept, removed, good, toxic, redundant = (steps[..., j].ravel() for j in range(1, 6))
                columns = [np.repeat(names, f.shape[1]).tolist(), [o for o in orders for _ in range(k)] * len(names), np.tile(np.arange(1, k + 1), len(names) * len(orders)), kept, removed, redundant, alone[of, f.ravel()], good, toxic, shapley[of, f.ravel()]]
                yield record([x.split()[0] for x in RESULT.split(", ")], columns, [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7])

    return cells.mapInArrow(listed, RESULT)

