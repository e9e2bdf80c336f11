"""An append-only log of events as a data source of Spark: `event_log`.

    spark.dataSource.register(EventLog)
    events.write.format("event_log").mode("append").save(path)
    spark.read.format("event_log").load(path)
    spark.readStream.format("event_log").load(path)

A batch is a partition for each file. The option `where`, see `where`, is settled where the files are read, by row
groups' bounds first. (It is an option since Spark 4.1 keeps filters that it has pushed to a Python source with
the loaded table: a second query of the same DataFrame would see the first one's.) A stream's offset is a commit's number, so a query that starts again from its
checkpoint goes on behind the last commit that it had, and commits are whole or not there. A stream written to
the log names itself by the option `writer`: a micro-batch that comes again after a failure is known by
its number and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql import datasource as api
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .journal import Journal

#: Comparisons that a scan settles, as functions of an Arrow field and a constant.
SETTLED = {
    "=": lambda f, x: f == x,
    ">": lambda f, x: f > x,
    ">=": lambda f, x: f >= x,
    "<": lambda f, x: f < x,
    "<=": lambda f, x: f <= x,
    "in": lambda f, x: f.isin(list(x)),
    "not null": lambda f, _: f.is_valid(),
}


def where(*conditions: tuple[str, str, Any]) -> str:
    """The option's value for conditions (column, comparison, constant), all of which rows have to meet."""
    for _, how, _ in conditions:
        if how not in SETTLED:
            raise ValueError(f"comparisons are {', '.join(SETTLED)}")
    return json.dumps(conditions)


@dataclass
class Part(api.InputPartition):
    file: str


@dataclass
class Staged(api.WriterCommitMessage):
    file: str
    rows: int


def path_of(options: dict) -> str:
    if not options.get("path"):
        raise ValueError("an event log needs a path")
    return options["path"]


def scanned(journal: Journal, file: str, schema: pa.Schema, condition: ds.Expression | None) -> Iterator[pa.RecordBatch]:
    """The rows of a file, read as they are asked for: Arrow's own threads would read a whole file ahead of a slow taker."""
    data = ds.dataset(journal.at("data", file), schema=schema, filesystem=journal.fs, format="parquet")
    ahead = {"batch_readahead": 0, "fragment_readahead": 0, "use_threads": False, "fragment_scan_options": ds.ParquetFragmentScanOptions(pre_buffer=False)}
    return (b for b in data.to_batches(columns=schema.names, filter=condition, batch_size=1 << 14, **ahead) if b.num_rows)


class Scan(api.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.schema, self.where = path_of(options), to_arrow_schema(schema), json.loads(options.get("where") or "[]")
        if unknown := {c for c, _, _ in self.where} - set(schema.names):
            raise ValueError(f"no column {', '.join(sorted(unknown))}")

    def condition(self) -> ds.Expression | None:
        own = [SETTLED[how](ds.field(c), x) for c, how, x in self.where]
        return reduce(and_, own) if own else None

    def partitions(self) -> list[Part]:
        journal = Journal(self.path)
        return [Part(f) for c in journal.commits(0, journal.last()) for f in c["files"]] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from scanned(Journal(self.path), partition.file, self.schema, self.condition())


class Follow(api.DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.schema = path_of(options), to_arrow_schema(schema)
        # The commit behind which a stream without a checkpoint starts.
        self.since = int(options.get("since", 0))

    def initialOffset(self) -> dict:
        return {"commit": self.since}

    def latestOffset(self) -> dict:
        return {"commit": max(self.since, Journal(self.path).last())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(f) for c in Journal(self.path).commits(start["commit"], end["commit"]) for f in c["files"]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return scanned(Journal(self.path), partition.file, self.schema, None)

    def commit(self, end: dict) -> None:
        """The log keeps its commits: other streams may read them."""


class Append(api.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.kind, self.schema = path_of(options), schema.json(), to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return Staged(*Journal(self.path).stage(iterator, self.schema))

    def add(self, messages: list[Staged | None], **more: object) -> None:
        journal, own = Journal(self.path), [m for m in messages if m]
        journal.discard(m.file for m in own if not m.rows)
        full = [m for m in own if m.rows]
        journal.commit(journal.last() + 1, {"files": [m.file for m in full], "rows": sum(m.rows for m in full), "schema": self.kind, **more})

    def commit(self, messages: list[Staged | None]) -> None:
        self.add(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        Journal(self.path).discard(m.file for m in messages if m)


class AppendStream(api.DataSourceStreamArrowWriter):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.own, self.writer = Append(schema, options), options.get("writer", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.own.write(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        journal = Journal(self.own.path)
        if done(journal, self.writer) >= batchId:
            self.abort(messages, batchId)
        else:
            self.own.add(messages, writer=self.writer, batch=batchId)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.own.abort(messages)


def done(journal: Journal, writer: str) -> int:
    """The last micro-batch of a writer that counts; -1 if none does."""
    for number in range(journal.last(), 0, -1):
        entry = journal.commit_of(number)
        if entry.get("writer") == writer:
            return entry["batch"]
    return -1


class EventLog(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> T.StructType:
        journal = Journal(path_of(self.options))
        if not (last := journal.last()):
            raise ValueError(f"the event log at {journal.path} has no events yet; give their schema")
        return T.StructType.fromJson(json.loads(journal.commit_of(last)["schema"]))

    def reader(self, schema: T.StructType) -> Scan:
        return Scan(schema, self.options)

    def streamReader(self, schema: T.StructType) -> Follow:
        return Follow(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Append:
        if overwrite:
            raise ValueError("an event log is only appended to")
        return Append(schema, self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> AppendStream:
        return AppendStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets Python workers import this package."""
    from . import tables
    from .ledger import Ledger

    tables.importable(spark)
    for source in (EventLog, Ledger):
        spark.dataSource.register(source)
