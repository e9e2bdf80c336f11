"""Incremental and reversible line dedup: exact reference counts, and cuckoo filters in shards before them.

A line's key is the line without white space at its ends, A-Z in lower case; keys of at least LEAST
code points count. An index is a folder of versions, each written once by Spark and valid from the
moment that its row in `commits` stands:

    postings/vN  key, doc_id, change      keys of the documents that came (+1) or went (-refs)
    counts/vN    key, docs, owner         exact: how many documents hold a key that the version touched, and the smallest doc_id
    filters/vN   shard, entries, filter   cuckoo filters of the shards that the version changed
    commits/vN   version, shards

A key has min(docs, 2) entries in its shard's filter: none means that no document holds it, one that
it needn't be looked up in order to know that it is in one document only. Filters spare the exact
tables most look-ups: a new document's unknown keys, and all lines that occur once. Deleting documents
takes their postings and filter entries back, and the lines that were dropped for their sake return.

Postings aren't shuffled on their own: counts are aggregated from them on the map side. A key in so many
documents that it would be hot (at most HOT keys are) is settled where its lines are read. Keys reach
filters by shard, of about SHARD_KEYS keys each, and a filter that gets too full is made anew, larger,
from the counts. Keys are 128-bit digests.

Defined results: a null or empty text is one empty line; a null doc_id is a document of its own, larger
than all others; rows that share a doc_id are one document; a document that is inserted again counts
once, and has to be deleted once; deleting unknown ids changes nothing; an empty table makes an empty
index. `dedup` keeps extra columns, and replaces those named n_lines, n_dropped and kept_text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, durable, partitions, prepare, record
from .cuckoo import Cuckoo, TooFull

LEAST = 10
WHITE = b" \t\n\v\f\r"
INNER = bytes(range(128, 192))
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Keys in a shard when the index is made, and keys that are settled where they are read, at most.
SHARD_KEYS, HOT, HOT_LEAST = 1 << 14, 5000, 1000
POSTINGS, COUNTS, FILTERS = "key binary, doc_id long, change long", "key binary, docs long, owner long", "shard int, entries long, filter binary"


def line_key(line: bytes) -> bytes | None:
    """A digest of the line's key; None if that is too short to count."""
    own = line.strip(WHITE)
    if len(own) < LEAST or len(own) < 4 * LEAST and len(own.translate(None, INNER)) < LEAST:
        return None
    return hashlib.blake2b(own.translate(LOWER), digest_size=16).digest()


def keys_of(text: bytes) -> set[bytes]:
    """The distinct keys of a text."""
    found = {line_key(line) for line in set(text.split(b"\n"))}
    return found - {None}


def digests(keys: list[bytes]) -> np.ndarray:
    """The keys' halves, of which the second goes to the filters; the first has what deals keys to shards."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def held(postings: DataFrame) -> DataFrame:
    """key, docs, owner of the keys that documents hold."""
    rows = postings.groupBy("key", "doc_id").agg(F.sum("change").alias("refs")).filter("refs > 0")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("owner"))


class LineIndex:
    """An index in a folder of shared storage; `path` is a new folder, or that of an index."""

    def __init__(self, spark: SparkSession, path: str, shard_keys: int = SHARD_KEYS) -> None:
        prepare(spark)
        self.spark, self.path, self.shard_keys, self.version, self.shards = spark, path, shard_keys, 0, 0
        try:
            last = spark.read.schema("version int, shards int").parquet(f"{path}/commits/v*").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last:
            self.version, self.shards = last["version"], last["shards"]

    def table(self, name: str, schema: str, since: int = 1) -> DataFrame:
        """All rows of the versions that stand, with their version."""
        own = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v{v}").withColumn("version", F.lit(v)) for v in range(since, self.version + 1)]
        out = own[0] if own else self.spark.createDataFrame([], f"{schema}, version int")
        for x in own[1:]:
            out = out.unionByName(x)
        return out

    def latest(self, name: str, schema: str, key: str) -> DataFrame:
        """The newest row of each key."""
        rows = self.table(name, schema)
        if self.version < 2:
            return rows.drop("version")
        own = [c for c in rows.columns if c != "version"]
        return rows.groupBy(key).agg(F.max_by(F.struct(*own), "version").alias("row")).select("row.*")

    def postings(self) -> DataFrame:
        return self.table("postings", POSTINGS).drop("version")

    def counts(self) -> DataFrame:
        """key, docs, owner of every key that a document holds."""
        return self.latest("counts", COUNTS, "key").filter("docs > 0")

    def filters(self) -> DataFrame:
        return self.latest("filters", FILTERS, "shard")

    def insert(self, docs: DataFrame) -> None:
        """Adds the documents (doc_id, text)."""

        def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                texts = batch["text"].cast(pa.binary()).to_pylist()
                rows = [(k, d) for d, t in zip(batch["doc_id"].to_pylist(), texts, strict=True) for k in keys_of(t or b"")]
                if rows:
                    keys, ids = zip(*rows, strict=True)
                    yield record(["key", "doc_id", "change"], [keys, ids, [1] * len(keys)], [pa.binary(), pa.int64(), pa.int64()])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, POSTINGS)
        self.update(rows)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents of the ids (column doc_id) back, however often each was inserted."""
        gone = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        own = self.postings().join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi")
        refs = own.groupBy("key", "doc_id").agg(F.sum("change").alias("refs")).filter("refs > 0")
        self.update(refs.select("key", "doc_id", (-F.col("refs")).alias("change")))

    def update(self, postings: DataFrame) -> None:
        """A version more: the postings, the counts of the keys that they touch, the filters that these change."""
        v, spark = self.version + 1, self.spark
        at = lambda name: f"{self.path}/{name}/v{v}"
        postings.write.mode("overwrite").parquet(at("postings"))
        new = spark.read.schema(POSTINGS).parquet(at("postings"))
        shards = self.shards or 1 << max(0, max(partitions(spark), -(-new.count() // self.shard_keys)) - 1).bit_length()
        touched = new.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        if self.version:
            # Keys that no filter knows are in no older version; the others meet their older postings and counts.
            touched = durable(self.through(touched.select("key"), shards))
            known = touched.filter("entries > 0").select("key")
            fresh = held(new.join(touched.filter("entries = 0"), "key", "left_semi")).withColumn("old", F.lit(0).cast("long"))
            again = held(self.postings().unionByName(new).join(known, "key", "left_semi"))
            was = self.counts().join(known, "key", "left_semi").select("key", F.col("docs").alias("old"))
            again = known.join(again, "key", "left").join(was, "key", "left").select("key", F.coalesce("docs", F.lit(0)).alias("docs"), "owner", F.coalesce("old", F.lit(0)).alias("old"))
            rows = fresh.select("key", "docs", "owner", "old").unionByName(again)
        else:
            rows = held(new).withColumn("old", F.lit(0).cast("long"))
        rows.write.mode("overwrite").parquet(at("counts"))
        changes = spark.read.schema(f"{COUNTS}, old long").parquet(at("counts"))
        self.change(changes, shards, v, at("filters"))
        spark.createDataFrame([(v, shards)], "version int, shards int").coalesce(1).write.mode("overwrite").parquet(at("commits"))
        self.version, self.shards = v, shards

    def sharded(self, keys: DataFrame, shards: int) -> DataFrame:
        """Adds shard to rows with a key."""
        half = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
        return keys.withColumn("shard", F.pmod(half, F.lit(shards)).cast("int"))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Each shard's rows in one partition, its filter first. They are dealt by a hash of the shard: where a
        join by the shard itself goes before, Spark would take that for the same and may split a skewed shard."""
        return rows.repartition(partitions(self.spark), F.xxhash64("shard")).sortWithinPartitions("shard", "role")

    def change(self, changes: DataFrame, shards: int, version: int, path: str) -> None:
        """Writes the filters of the shards that the changes (key, docs, old) touch."""
        two = lambda c: F.least(F.col(c), F.lit(2))
        moves = self.sharded(changes.select("key", (two("docs") - two("old")).alias("change")).filter("change <> 0"), shards)
        grown = moves.groupBy("shard").agg(F.sum("change").alias("more"))
        old = self.filters()
        room = F.octet_length("filter") / 2 * 0.9
        # Filters that lack the room, and new ones, are made from the exact counts.
        anew = grown.join(old, "shard", "left").filter(F.col("filter").isNull() | (F.col("entries") + F.col("more") > room)).select("shard")
        anew = durable(anew)
        none = F.lit(None).cast("binary")
        exact = changes if version == 1 else self.counts().select("key", "docs").join(changes.select("key"), "key", "left_anti").unionByName(changes.select("key", "docs"))
        whole = self.sharded(exact.select("key", two("docs").alias("change")).filter("change > 0"), shards).join(anew, "shard", "left_semi")
        rows = whole.select("shard", F.lit(1).alias("role"), "key", "change", none.alias("filter"))
        if version > 1:
            kept = old.join(grown.select("shard"), "shard", "left_semi").join(anew, "shard", "left_anti")
            rows = rows.unionByName(kept.select("shard", F.lit(0).alias("role"), none.alias("key"), F.col("entries").alias("change"), "filter"))
            rows = rows.unionByName(moves.join(anew, "shard", "left_anti").select("shard", F.lit(1).alias("role"), "key", "change", none.alias("filter")))

        def built(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, own, entries, keys, moved = None, None, 0, [], []

            def made() -> pa.RecordBatch:
                halves, change = digests(keys)[:, 1], np.array(moved, np.int64)
                gone, come = np.repeat(halves, np.maximum(0, -change)), np.repeat(halves, np.maximum(0, change))
                if own is None:
                    out, room = None, max(1, len(come))
                    while out is None:
                        out = Cuckoo.sized(room)
                        try:
                            out.insert(come)
                        except TooFull:
                            out, room = None, room * 2
                else:
                    out = own
                    out.delete(gone)
                    out.insert(come)
                return record(["shard", "entries", "filter"], [[shard], [entries + int(change.sum())], [out.raw()]], [pa.int32(), pa.int64(), pa.binary()])

            for batch in source:
                for s, role, key, change, raw in zip(*(batch[c].to_pylist() for c in ("shard", "role", "key", "change", "filter")), strict=True):
                    if s != shard:
                        if shard is not None:
                            yield made()
                        shard, own, entries, keys, moved = s, None, 0, [], []
                    if role:
                        keys.append(key)
                        moved.append(change)
                    else:
                        own, entries = Cuckoo.read(raw), change
            if shard is not None:
                yield made()

        self.dealt(rows).mapInArrow(built, FILTERS).write.mode("overwrite").parquet(path)

    def through(self, keys: DataFrame, shards: int | None = None) -> DataFrame:
        """The rows, with entries: how often a filter has their key, or something like it (0, 1, 2 or more)."""
        shards = shards or self.shards
        names, schema = keys.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
        rows = self.sharded(keys, shards).select("shard", F.lit(1).alias("role"), F.lit(None).cast("binary").alias("filter"), *names)
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in keys.schema.fields]
        filters = self.filters().select("shard", F.lit(0).alias("role"), "filter", *empty)

        def probed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, own = None, None
            for batch in source:
                shard_of, role = (batch[c].to_numpy() for c in ("shard", "role"))
                cuts = np.flatnonzero(np.concatenate(([True], shard_of[1:] != shard_of[:-1]))).tolist() if len(shard_of) else []
                for low, high in zip(cuts, [*cuts[1:], len(shard_of)], strict=True):
                    if shard_of[low] != shard:
                        shard, own = shard_of[low], None
                    if not role[low]:
                        own, low = Cuckoo.read(batch["filter"][low].as_py()), low + 1
                    if high > low:
                        part = batch.slice(low, high - low)
                        found = own.count(digests(part["key"].to_pylist())[:, 1]) if own is not None else np.zeros(high - low, np.int64)
                        yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(found.astype(np.int32))], names=[*names, "entries"])

        return self.dealt(filters.unionByName(rows)).mapInArrow(probed, f"{schema}, entries int")

    def hot(self) -> dict[bytes, int | None]:
        """Owners of the keys that more than 1/HOT of all references go to: at most HOT keys."""
        shared = self.counts().filter("docs > 1")
        floor = max(HOT_LEAST, (shared.agg(F.sum("docs")).first()[0] or 0) // HOT)
        return {bytes(r["key"]): r["owner"] for r in shared.filter(F.col("docs") > floor).collect()}

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs, which the index has, with n_lines (before), n_dropped and kept_text: lines whose key more
        than one document holds are dropped, except in the one with the smallest doc_id."""
        outputs = ["n_lines", "n_dropped", "kept_text"]
        kept = [c for c in docs.columns if c not in outputs]
        docs, hot = docs.select(*kept), self.hot()
        # A row's own id and hash of the text tell where its lines belong.
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")

        def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            rows = [(k, d, h) for d, h, t in zip(batch["doc_id"].to_pylist(), batch["t"].to_pylist(), texts, strict=True) for k in keys_of(t or b"") if k not in hot]
            return record(["key", "doc_id", "t"], list(zip(*rows, strict=True)) or [[]] * 3, [pa.binary(), pa.int64(), pa.int64()])

        lines = self.through(ids.mapInArrow(batches(asked), "key binary, doc_id long, t long")).filter("entries > 1").drop("entries")
        shared = self.counts().filter("docs > 1").select("key", "owner")
        lost = lines.join(shared, "key").filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
        lost = lost.groupBy("doc_id", "t").agg(F.collect_set("key").alias("__lost")).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "__lost")
        rows = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t")), "left").select(*kept, F.col("doc_id").cast("long").alias("__of"), "__lost")

        def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                out = []
                for doc, text, lost in zip(batch["__of"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["__lost"].to_pylist(), strict=True):
                    lines, lost = (text or b"").split(b"\n"), set(lost or ())
                    left = [x for x in lines if (k := line_key(x)) is None or k not in lost and (k not in hot or hot[k] == doc)]
                    out.append((len(lines), len(lines) - len(left), b"\n".join(left)))
                if out:
                    n, dropped, body = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(body, pa.binary()).cast(pa.string())], names=[*kept, *outputs])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
        return rows.mapInArrow(cut, ", ".join([*fields, "n_lines long", "n_dropped long", "kept_text string"]))
