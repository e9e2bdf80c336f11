"""Leases and revisions as running streams, with typed state and timers.

`monitor` watches heartbeats, `authority` answers requests. Both keep a few small state variables for a
key and a timer at the end of the lease that stands: that a lease has run out is said when its time
comes, whether or not anything arrives for it. Where a later row shows it first, it is said then; either
way once, so that the rows are the same however a stream is cut into micro-batches, as long as those of a key come
in the order of their times.

Times are milliseconds. With event time, timers follow the watermark; with processing time they follow the
clock, and state may be forgotten after a silence. State needs the RocksDB store, see `store`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources import tables
from . import lease as rules

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUSES = "revision_id string, fence long, at long, status string"
ANSWERS = "revision_id string, seq long, request string, status string, reason string, token string, fence long"


def store(spark: SparkSession) -> None:
    """Sets the state store that these streams need; it holds for the streams that a session starts from then on."""
    tables.importable(spark)
    spark.conf.set(STORE, ROCKS)


def rows_of(rows: Iterator[Row], *order: str) -> list[Row]:
    """A key's rows in order, nulls last."""
    return sorted(rows, key=lambda r: tuple((r[c] is None, 0 if r[c] is None else r[c]) for c in order))


def framed(rows: list[tuple], schema: str) -> Iterator[Row]:
    """Rows of a schema."""
    made = Row(*(c.split()[0] for c in schema.split(", ")))
    return (made(*r) for r in rows)


class Timed(StatefulProcessor):
    """One value and one timer for each key. The value says when the timer is due, and is read and written once for all
    rows of a micro-batch, since each look at the state is a message to Spark and back."""

    handle: StatefulProcessorHandle
    kept: str

    def __init__(self, lease: int, forget: int | None = None) -> None:
        self.lease, self.forget = lease, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", self.kept, self.forget)

    def until(self, before: int | None, at: int | None) -> None:
        """Moves the key's timer, or takes it away."""
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Monitor(Timed):
    """Statuses of heartbeats: `extended`; `timeout` if the answer came late or never; `expired` for a beat after the
    lease's end, and `lost` for all after either; and `lapsed` at the end of a lease that nothing extended."""

    kept = "until long, lost boolean, lapsed boolean, due long"

    def __init__(self, lease: int, timeout: int, forget: int | None = None) -> None:
        super().__init__(lease, forget)
        self.timeout = timeout

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        end, lost, lapsed, due = self.own.get() or (None, False, False, None)
        out = []
        for r in rows_of(rows, "at", "answered_at"):
            at, answered = int(r["at"]), r["answered_at"]
            end = int(r["granted_at"]) + self.lease if end is None else end
            if lost:
                status = "lost"
            elif at >= end:
                if not lapsed:
                    out.append((*key, end, "lapsed"))
                status, lost, lapsed = "expired", True, True
            elif answered is None or answered - at > self.timeout:
                status, lost = "timeout", True
            else:
                status, end = "extended", at + self.lease
            out.append((*key, at, status))
        if end is not None:
            later = None if lost or lapsed else end
            self.until(due, later)
            self.own.update((end, lost, lapsed, later))
        yield from framed(out, STATUSES)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        end, lost, _, due = self.own.get() or (None, False, False, None)
        # A timer of state that has been forgotten says nothing.
        if due is not None and due == expiredTimerInfo.getExpiryTimeInMs():
            self.own.update((end, lost, True, None))
            yield from framed([(*key, end, "lapsed")], STATUSES)


class Authority(Timed):
    """Answers to requests, by the rules of `lease.apply`; and `expired` when a lease runs out that was neither
    released nor used up."""

    kept = "negative string, seen string, fence long, token string, expires_at long, completed boolean, persisted string, invalidated boolean, retraction string, due long"

    def record(self) -> tuple[rules.Record, int | None]:
        """The key's record, and when its timer is due."""
        found = self.own.get()
        if found is None:
            return rules.Record(), None
        negative, seen, *rest, due = found
        return rules.Record(negative, seen.split(",") if seen else [], *rest), due

    def keep(self, r: rules.Record, due: int | None) -> None:
        self.own.update((r.negative, ",".join(r.seen), r.fence, r.token, r.expires_at, r.completed, r.commit, r.invalidated, r.retraction, due))

    def over(self, record: rules.Record, key: tuple, now: int | None) -> list[tuple]:
        """The row that says that the lease has run out by now, which also takes it away."""
        if record.token is None or now is not None and record.expires_at > now:
            return []
        token, record.token = record.token, None
        return [(key[0], record.expires_at, "timer", "expired", "", token, record.fence)]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        (record, due), out = self.record(), []
        for r in rows_of(rows, "at", "seq"):
            request = r.asDict()
            out += self.over(record, key, int(r["at"]))
            a = rules.apply(record, key[0], request, self.lease)
            out.append((key[0], int(r["seq"]), r["request"], a["status"], a["reason"], a["token"], a["fence"]))
        later = record.expires_at if record.token else None
        self.until(due, later)
        self.keep(record, later)
        yield from framed(out, ANSWERS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        record, due = self.record()
        # A timer of state that has been forgotten says nothing.
        if due is not None and due == expiredTimerInfo.getExpiryTimeInMs():
            out = self.over(record, key, due)
            self.keep(record, None)
            yield from framed(out, ANSWERS)


def run(rows: DataFrame, keys: list[str], processor: Timed, schema: str, late: str | None) -> DataFrame:
    """late: how late rows may be by event time (column ts); None for processing time."""
    store(rows.sparkSession)
    mode = "ProcessingTime" if late is None else "EventTime"
    if late is not None:
        rows = rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return rows.groupBy(*keys).transformWithState(processor, schema, "Append", mode)


def monitor(beats: DataFrame, lease: int = rules.LEASE, timeout: int = rules.HEARTBEAT_TIMEOUT, late: str | None = "1 second", forget: int | None = None) -> DataFrame:
    """revision_id, fence, at and status for a stream of heartbeats (revision_id, fence, granted_at, at, answered_at)."""
    return run(beats, ["revision_id", "fence"], Monitor(lease, timeout, forget), STATUSES, late)


def authority(requests: DataFrame, lease: int = rules.LEASE, late: str | None = "1 second", forget: int | None = None) -> DataFrame:
    """Answers to a stream of requests (revision_id, seq, request, at, type, token, fence, commit). Of the rows that say
    that a lease has run out, seq is the time of that."""
    return run(requests, ["revision_id"], Authority(lease, forget), ANSWERS, late)
