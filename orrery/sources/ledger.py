"""What became of revisions, as a sink that merges: `decision_ledger`.

    spark.dataSource.register(Ledger)
    dealt(decisions, keys).write.format("decision_ledger").mode("append").options(keys="a,b", writer="w", batch=7).save(path)
    spark.read.format("decision_ledger").load(path)

(A stream in update mode hands its micro-batches over, since Spark doesn't let Python sinks take that mode themselves; one
in append mode may write to the format directly; Spark sorts no stream, so a task of it holds its micro-batch's rows.)

Rows are (keys, action, reason). The ledger has one row of kind `decision` for each key, the latest, and where
a revision that was saved is discarded later, one of kind `retraction` too, which stays: what was published
has to be taken back. A reader finds the merged rows and has nothing to aggregate.

The ledger is dealt to buckets by key, one file each, in the order of keys. A task merges the buckets whose rows it gets, all
rows of a bucket having to come to one task and in that order (`dealt` sees to that), with what the files hold, both as they
come, so that it holds no bucket whole, and writes new files; the driver's commit
puts them in place of the old ones, all at once. A task that fails leaves files that nobody names, which abort
removes. A micro-batch that comes again is known by its writer and number, and changes nothing.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import datasource as api
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .event_log import done, path_of, scanned
from .journal import Journal

BUCKETS = 16
#: The column by which rows of a bucket are in order: their keys as text.
PLACE = "__place"
#: What the ledger adds to a decision's columns.
ADDED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("commit", T.LongType())])


@dataclass
class Part(api.InputPartition):
    file: str


@dataclass
class Merged(api.WriterCommitMessage):
    files: dict[int, str] = field(default_factory=dict)


def dealt(decisions: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows with their bucket and place, each bucket in one task and in order."""
    place = F.to_json(F.struct(*(F.col(k).cast("string") for k in keys)), {"ignoreNullFields": "false"})
    rows = decisions.withColumn(PLACE, place).withColumn("bucket", F.pmod(F.crc32(F.col(PLACE).cast("binary")), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
    return rows if decisions.isStreaming else rows.sortWithinPartitions("bucket", PLACE)


def whole(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in ("bucket", PLACE, *ADDED.names)] + ADDED.fields)


def state(journal: Journal) -> dict:
    """The last commit, or what stands before any."""
    last = journal.last()
    return journal.commit_of(last) if last else {"files": {}, "schema": None}


OUT_OF_ORDER = "rows of one bucket came to several tasks, or out of order: see dealt"


def in_order(rows: Iterator[dict]) -> Iterator[dict]:
    """The rows, checked as they come."""
    last = ""
    for r in rows:
        if r[PLACE] is None or r[PLACE] < last:
            raise ValueError(OUT_OF_ORDER)
        last = r[PLACE]
        yield r


class Merge(api.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.writer, self.batch = path_of(options), options.get("writer", ""), int(options.get("batch", -1))
        self.keys = [k.strip() for k in options.get("keys", "").split(",") if k.strip()]
        if not self.keys or {"bucket", PLACE, "action", "reason", *self.keys} - set(schema.names):
            raise ValueError("a ledger needs keys, and rows with bucket, action and reason")
        self.kind, self.schema = whole(schema).json(), to_arrow_schema(whole(schema)).append(pa.field(PLACE, pa.string()))

    def write(self, iterator: Iterator[pa.RecordBatch], ordered: bool = True) -> Merged:
        journal, rows = Journal(self.path), (r for b in iterator for r in b.to_pylist())
        files, number = state(journal)["files"], journal.last() + 1
        out = Merged()
        for bucket, new in groupby(rows if ordered else sorted(rows, key=itemgetter("bucket", PLACE)), itemgetter("bucket")):
            if bucket in out.files:
                raise ValueError(OUT_OF_ORDER)
            old = (r for b in scanned(journal, files[str(bucket)], self.schema, None) for r in b.to_pylist()) if str(bucket) in files else iter(())
            merged = self.merged(in_order(old), in_order(new), number)
            out.files[bucket], _ = journal.stage((pa.RecordBatch.from_pylist(list(part), self.schema) for part in batched(merged, 1 << 13)), self.schema)
        return out

    def merged(self, old: Iterator[dict], new: Iterator[dict], number: int) -> Iterator[dict]:
        """The rows of a bucket after a commit of this number, in order; one decision a key is in `new`."""
        fresh = (r | {"kind": None} for r in new)
        # Of rows of one place the old ones come first.
        for _, same in groupby(heapq.merge(old, fresh, key=itemgetter(PLACE)), itemgetter(PLACE)):
            own: dict[str, dict] = {}
            for r in same:
                if r["kind"]:
                    own[r["kind"]] = r
                    continue
                was = own.get("decision")
                if was and was["action"] == "save" and r["action"] == "discard":
                    own.setdefault("retraction", r | {"kind": "retraction", "commit": number})
                own["decision"] = r | {"kind": "decision", "commit": number}
            yield from own.values()

    def commit(self, messages: list[Merged | None]) -> None:
        journal, own = Journal(self.path), [m for m in messages if m]
        if 0 <= self.batch <= done(journal, self.writer):
            self.abort(messages)
            return
        names = [b for m in own for b in m.files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("rows of one bucket came to several tasks")
        before = state(journal)["files"]
        files = before | {str(b): f for m in own for b, f in m.files.items()}
        # Readers of the commit before may still be at its files, but not at those that it had replaced.
        replaced = [before[b] for b in before if files[b] != before[b]]
        old = state(journal).get("replaced", [])
        journal.commit(journal.last() + 1, {"files": files, "replaced": replaced, "schema": self.kind, "writer": self.writer, "batch": self.batch})
        journal.discard(old)

    def abort(self, messages: list[Merged | None]) -> None:
        Journal(self.path).discard(f for m in messages if m for f in m.files.values())


class MergeStream(api.DataSourceStreamArrowWriter):
    def __init__(self, own: Merge) -> None:
        self.own = own

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Merged:
        return self.own.write(iterator, ordered=False)

    def commit(self, messages: list[Merged | None], batchId: int) -> None:  # noqa: N803
        self.own.batch = batchId
        self.own.commit(messages)

    def abort(self, messages: list[Merged | None], batchId: int) -> None:  # noqa: N803
        self.own.abort(messages)


class Look(api.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.schema = path_of(options), to_arrow_schema(schema)

    def partitions(self) -> list[Part]:
        return [Part(f) for f in state(Journal(self.path))["files"].values()] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from scanned(Journal(self.path), partition.file, self.schema, None)


class Ledger(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "decision_ledger"

    def schema(self) -> T.StructType:
        last = state(Journal(path_of(self.options)))
        if last["schema"] is None:
            raise ValueError("the ledger has no decisions yet; give their schema")
        return T.StructType.fromJson(json.loads(last["schema"]))

    def reader(self, schema: T.StructType) -> Look:
        return Look(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Merge:
        if overwrite:
            raise ValueError("a ledger is merged into")
        return Merge(schema, self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> MergeStream:
        return MergeStream(Merge(schema, self.options))

