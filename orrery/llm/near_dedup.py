"""Near-duplicates: ProbMinHash signatures, banding, and exact verification.

Shingles of five words carry weights. Each shingle is a Poisson process whose rate is its weight:
arrivals in increasing time fall on random registers, a register keeps its earliest arrival, and a
shingle stops as soon as its next arrival comes after the latest register. Two signatures agree in a
register with the probability Jaccard likeness of the weighted sets. Bands of registers nominate,
for a text with repeated shingles those of equal weights as well;
the Jaccard likeness of the shingle sets decides: a link is 0.8 or more.

Texts with equal shingle sets are one node. Within a bucket nodes aren't paired with one another:

1.  The leader of a bucket is the node that meets most others, and a node's pivot the busiest leader of
    its buckets. Every node is compared with its pivot; links make classes. A bucket whose members are
    all of one class is done.
2.  In what is left, members that have several pivots are compared with the bucket's leader, and
    members that aren't linked to their pivot with the busiest of that kind. Links join classes, and
    buckets of one class are done.
3.  Two members of a bucket now have a pivot or leader P in common. Let D and M be what a member has
    beyond P and what it misses of P, and X both together. Then, with
    cost(x) = |M| + 0.8 |D| - 0.1 |P|,

        J(y, z) >= 0.8  <=>  1.8 |X_y & X_z| >= cost(y) + cost(z),

    and a text isn't linked to P if its cost is over 0.1 |P|. So a pair of which one isn't linked to P
    shares elements of X. With the rarest elements of a star first, it shares one among the first
    |X| + 1 - needed of both, and pairs of different classes that do are compared.

So a large cloud of near copies costs a comparison or two for each member, and no link between classes
is lost among members of a bucket. Shingles are compared by 32-bit hashes.

Defined results: a text with no word is never linked, and one with fewer than five words has a single
shingle, all its words; a null text counts as empty; a null doc_id sorts last; repeated rows are
copies of each other. Extra columns are ignored by `classes` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, durable, only, prepare

WORDS, LIKE = 5, 0.8
BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
#: Sets of fewer shingles are linked only to equal ones: 3 of 4 is less than 0.8.
LEAST = 4
#: What rounding may take from a bound that is met exactly.
SLIGHT = 1e-9
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MOST_CACHED = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles as sorted 64-bit hashes, and how often each occurs."""
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > MOST_CACHED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(hashes) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(hashes))):
            rolled = rolled * GOLDEN + hashes[k : k + n]
        return np.unique(mixed(rolled), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """Repetition adds a little: a shingle's weight is 1 + ln(count) / 10."""
    return 1 + np.log(counts) / 10


def signatures(keys: list[np.ndarray], rates: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (uint32) of many weighted sets at once; sets may not be empty."""
    key, rate = np.concatenate(keys), np.concatenate(rates)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Arrival time as float32 bits, which sort like the times, above the shingle's hash.
    found = np.full(len(keys) * registers, unset)
    low, time, turn = key & np.uint64(0xFFFFFFFF), np.zeros(len(key)), 0
    table, latest = found.reshape(-1, registers), np.full(len(keys), unset)
    while len(key):
        turn += 1
        h = mixed(key + np.uint64(turn * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / rate
        register = (mixed(h ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
        np.minimum.at(found, owner * registers + register, packed)
        running = np.flatnonzero(np.bincount(owner, minlength=len(keys)))
        latest[running] = table[running].max(1)
        go = (latest[owner] == unset) | (packed < latest[owner])
        key, rate, owner, low, time = key[go], rate[go], owner[go], low[go], time[go]
    return (found & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = mixed(out * GOLDEN + parts[:, :, k])
    return out.view(np.int64)


def node_of(keys: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes())).view(np.int64))


def parts(source: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut down to about `most` bytes of text: signatures take some hundred bytes a word at once."""
    for batch in source:
        rows = max(1, min(batch.num_rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, bands: node is null for a text without a word, bands empty if no link is possible."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = only(("shingler",), Shingler)
        for batch in parts(source):
            sets = [shingled(t) for t in batch["text"].to_pylist()]
            wide = [i for i, (k, _) in enumerate(sets) if len(k) >= LEAST]
            bands: list = [[]] * len(sets)
            if wide:
                made = band_keys(signatures([sets[i][0] for i in wide], [weights(sets[i][1]) for i in wide]))
                for i, row in zip(wide, made, strict=True):
                    bands[i] = row
            # By equal weights too, as verification sees them; where nothing is repeated they are the same.
            if repeated := [i for i in wide if sets[i][1].max() > 1]:
                made = band_keys(signatures([sets[i][0] for i in repeated], [np.ones(len(sets[i][0])) for i in repeated]))
                for i, row in zip(repeated, made, strict=True):
                    bands[i] = np.union1d(bands[i], row)
            nodes = [node_of(k) if len(k) else None for k, _ in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, node long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingled = only(("shingler",), Shingler)
        sets = [shingled(t)[0] for t in batch["text"].to_pylist()]
        short = [np.unique((k >> np.uint64(32)).astype(np.uint32)).view(np.int32) for k in sets]
        return pa.RecordBatch.from_arrays([pa.array([node_of(k) if len(k) else None for k in sets], pa.int64()), pa.array(short, pa.list_(pa.int32()))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(batches(read), "node long, shingles array<int>").filter("node IS NOT NULL")


def verified(pairs: DataFrame, sets: DataFrame, spread: bool = False) -> DataFrame:
    """pairs (a, b) with size_a, size_b, shared and like; spread adds what b has beyond a (more) and misses of it (less)."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    kept = ["a", "b", F.size("sa").alias("size_a"), F.size("sb").alias("size_b")]
    if spread:
        both = both.select(*kept, F.array_except("sb", "sa").alias("more"), F.array_except("sa", "sb").alias("less"))
        both = both.withColumn("shared", F.col("size_b") - F.size("more"))
    else:
        both = both.select(*kept, F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return both.withColumn("like", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))


def labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """buckets with the label of each node: its own number if it has no link yet."""
    return buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose members are of more than one class so far, with their labels."""
    rows = labelled(buckets, labels)
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    return rows.join(mixed, "bucket")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b)."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
    top = components(ends).select(F.col("node").alias("label"), F.col("label").alias("upper"))
    # A node without a link so far may be in `ends` under its own number.
    known = labels.join(top, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))
    fresh = top.select(F.col("label").alias("node"), F.col("upper").alias("label")).join(labels.select("node"), "node", "left_anti")
    return durable(known.unionByName(fresh))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("like") >= LIKE).select("a", "b")


def families(buckets: DataFrame, copies: DataFrame, sets: DataFrame) -> DataFrame:
    """Labels (node, label) of the nodes of buckets (bucket, node, n) that are linked to another."""
    # The original of a family has most in common with the others, so it leads wherever it occurs.
    met = buckets.groupBy("node").agg(F.sum("n").alias("met")).join(copies, "node")
    tops = durable(buckets.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "copies", "node")).alias("top")))
    led = durable(buckets.select("bucket", "node").join(tops, "bucket"))
    pivots = durable(led.groupBy("node").agg(F.max("top")["node"].alias("pivot")))
    led = led.select("bucket", "node", F.col("top.node").alias("leader"))

    pairs = pivots.filter("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    first = durable(verified(pairs, sets))
    labels = merged(pivots.limit(0).select("node", F.col("node").alias("label")), linked(first))

    # Within buckets of several classes: members of several pivots meet their leader, and those that
    # aren't linked to their pivot meet the one among them that meets most.
    rest = durable(still_open(led.join(pivots, "node"), labels))
    several = rest.groupBy("bucket").agg(F.min("pivot").alias("p"), F.max("pivot").alias("q")).filter("p <> q").select("bucket")
    to_leader = rest.join(several, "bucket").filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    loose = rest.filter("node <> pivot").join(first.filter(F.col("like") < LIKE).select(F.col("b").alias("node")), "node")
    met = loose.join(loose.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").groupBy("node").agg(F.sum("n").alias("met"))
    tops = loose.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("top"))
    second = loose.select("bucket", "node").join(tops, "bucket").groupBy("node").agg(F.max("top")["node"].alias("a")).filter("a <> node").select("a", F.col("node").alias("b"))
    asked = to_leader.withColumn("star", F.lit(True)).unionByName(second.withColumn("star", F.lit(False)))
    asked = durable(asked.groupBy("a", "b").agg(F.bool_or("star").alias("star")).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    tried = durable(verified(asked, sets))
    labels = merged(labels, linked(tried))

    # Pairs of different classes in one bucket have both met a pivot or leader of theirs.
    rest = durable(still_open(rest.drop("label"), labels).select("node", "label").distinct())
    stars = first.select("a", "b", "size_a", "size_b", "shared", "like").unionByName(tried.join(asked.filter("star"), ["a", "b"]).drop("star"))
    found = across(stars.join(rest.withColumnRenamed("node", "b"), "b"), sets)
    return merged(labels, linked(verified(found, sets)))


def across(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels that may be linked though one of the two isn't linked to their pivot.

    stars: a (the pivot), b, size_a, size_b, shared, like (of b and its pivot), label (of b)."""
    more, less, size = F.col("size_b") - F.col("shared"), F.col("size_a") - F.col("shared"), F.col("size_a")
    stars = stars.select("a", "b", "label", (F.col("like") < LIKE).alias("open"), (more + less).alias("size"), (less + LIKE * more - (1 - LIKE) / 2 * size).alias("cost"))
    by_pivot = stars.groupBy("a").agg(F.min(F.when(F.col("open"), F.col("cost"))).alias("least_open"), F.min("cost").alias("least"), F.min("label").alias("low"), F.max("label").alias("high"))
    by_pivot = durable(by_pivot.filter("least_open IS NOT NULL AND low <> high").drop("low", "high"))
    needed = needs(F.col("cost"), F.when(F.col("open"), F.col("least")).otherwise(F.col("least_open")))
    stars = stars.join(by_pivot, "a").withColumn("reach", F.col("size") + 1 - needed).filter("reach > 0")
    place = ["label", "open", "size", "cost", "reach"]
    stars = durable(stars.select("a", "b", *place))
    beyond = verified(stars, sets, spread=True).select("a", "b", F.concat("more", "less").alias("beyond"))
    elements = durable(stars.join(beyond, ["a", "b"]).select("a", "b", *place, F.explode("beyond").alias("s")))
    groups = elements.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.bool_or("open").alias("any_open"), F.min("label").alias("low"), F.max("label").alias("high"))
    groups = durable(groups.filter("any_open AND low <> high").select("a", "s", "n"))
    # What no pair in question shares comes first, then rare elements: a pair that shares enough of them
    # shares one near the beginning of both.
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("n", F.lit(0)), "s"))
    ranked = elements.join(groups, ["a", "s"], "left").withColumn("rank", rank).filter("rank <= reach AND n IS NOT NULL")
    ranked = durable(ranked.select("a", "s", "b", *place, "rank"))
    one = ranked.filter("open").select("a", "s", *(F.col(c).alias(f"y_{c}") for c in ["b", *place, "rank"]))
    other = ranked.select("a", "s", *(F.col(c).alias(f"z_{c}") for c in ["b", *place, "rank"]))
    enough = needs(F.col("y_cost"), F.col("z_cost"))
    can = (F.col("y_label") != F.col("z_label")) & (F.col("y_rank") <= F.col("y_size") + 1 - enough) & (F.col("z_rank") <= F.col("z_size") + 1 - enough)
    # Two that are both open meet once.
    can = can & (~F.col("z_open") | (F.col("y_b") < F.col("z_b")))
    pairs = one.join(other, ["a", "s"]).filter(can)
    return durable(pairs.select(F.least("y_b", "z_b").alias("a"), F.greatest("y_b", "z_b").alias("b")).distinct())


def needs(cost: Column, other: Column) -> Column:
    """How many elements two texts must share of those in which they differ from their pivot."""
    return F.ceil((cost + other) / (1 + LIKE) - SLIGHT)


def components(links: DataFrame) -> DataFrame:
    """node, label for the nodes of links (a, b): label is the same for all nodes of a component, and one of them.

    In each round a node goes to the smallest of itself and its neighbours, and on to where that one goes;
    what goes to one place is one node from then on, so that links become fewer quickly. Numbers of nodes
    are hashes: chains in ascending order are short."""
    edges = durable(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        goes = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        upper = goes.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        goes = durable(goes.join(upper, "label").select("node", F.col("upper").alias("label")))
        steps.append(goes)
        for end in ("a", "b"):
            edges = edges.join(goes.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end)
        edges = durable(edges.filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[0]
    for goes in steps[1:]:
        upper = goes.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        labels = labels.join(upper, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))
    return durable(labels) if len(steps) > 1 else labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), class_id (smallest doc_id of the class), class_size, kept (the class_id's row)."""
    prepare(docs.sparkSession)
    rows = durable(signed(docs))
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    nodes = durable(nodes)
    copies = nodes.select("node", "copies")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    # Kept before the join, so that a bucket of many members can be dealt to several tasks there.
    shared = durable(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    buckets = durable(buckets.join(shared, "bucket").select("bucket", "node", "n"))
    wanted = buckets.select("node").distinct().join(nodes.select("node", "low"), "node").select(F.col("low").alias("__low")).distinct()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__low")), "left_semi")
    sets = durable(shingle_sets(chosen).dropDuplicates(["node"]))
    labels = families(buckets, copies, sets)
    nodes = nodes.drop("bands").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = nodes.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    nodes = nodes.join(whole, "label").select("node", "class_id", "class_size")
    out = rows.select("doc_id", "text_key", "node").join(nodes, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class, and what repeats it."""
    gone = classes(docs).filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(durable(gone), same, "left_anti")
