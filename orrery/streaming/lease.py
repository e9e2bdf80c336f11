"""Leases with fencing: who may publish a revision, and until when.

The rules are a pure function of a record and a request, applied in the order of requests: in batches
over sorted groups, and in streams with the record as keyed state. Times are milliseconds.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.outcome import COMPILED, NEGATIVE, RENDERED, SUCCESS

#: Milliseconds. Fixed values.
LEASE, HEARTBEAT, HEARTBEAT_TIMEOUT, CLEANUP, OPERATION = 60_000, 20_000, 10_000, 10_000, 300_000
REQUESTS = ("event", "acquire", "heartbeat", "checkpoint", "commit", "release")


@dataclass
class Record:
    """All that is remembered of a revision."""

    negative: str | None = None
    seen: list[str] = field(default_factory=list)
    fence: int = 0
    token: str | None = None
    expires_at: int = 0
    completed: bool = False
    commit: str | None = None
    invalidated: bool = False
    retraction: str | None = None


def decided(record: Record) -> tuple[str, str]:
    if record.negative:
        return "discard", record.negative
    success = next((s for s in SUCCESS if s in record.seen), None)
    if success is None:
        return "wait", "no-success-signal"
    if COMPILED in record.seen and RENDERED in record.seen:
        return "save", success
    return "wait", "awaiting-compile-and-render"


def check_timing(lease: int = LEASE, heartbeat: int = HEARTBEAT, timeout: int = HEARTBEAT_TIMEOUT) -> None:
    if heartbeat >= lease or heartbeat + timeout >= lease:
        raise ValueError("a heartbeat and its timeout have to fit into a lease")


def apply(record: Record, key: str, request: dict, lease: int = LEASE) -> dict:
    """Changes the record and says what became of the request: {status, reason, token, fence}.

    A request for a lease names its kind and time, and where it holds one its token and fence. Without
    the current token and fence a heartbeat, checkpoint or commit is stale, and a release has no effect.
    """
    kind, now = request["request"], int(request["at"])
    answer = lambda status, reason="": {"status": status, "reason": reason, "token": record.token if status == "acquired" else None, "fence": record.fence}
    if kind == "event":
        name = request.get("type") or ""
        if name in NEGATIVE:
            record.negative = record.negative or name
            record.token = None
            if record.completed and not record.invalidated:
                record.invalidated, record.retraction = True, "pending"
                return answer("retract", record.commit or "")
        elif name in (*SUCCESS, COMPILED, RENDERED) and name not in record.seen:
            record.seen.append(name)
        return answer("recorded", name)
    action, reason = decided(record)
    if kind == "acquire":
        if action != "save":
            return answer("discarded" if action == "discard" else "waiting", reason)
        if record.completed:
            return answer("completed", reason)
        if record.token and record.expires_at > now:
            return answer("busy", reason)
        record.fence += 1
        record.token, record.expires_at = f"lease-{key}-{record.fence}", now + lease
        return answer("acquired", reason)
    holds = record.token is not None and request.get("token") == record.token and request.get("fence") == record.fence
    if kind == "release":
        # Conditional: a late worker can't take a newer one's lease away.
        if holds:
            record.token = None
        return answer("released" if holds else "ignored")
    if action != "save":
        return answer("canceled", reason)
    if not holds or record.expires_at <= now:
        return answer("stale", "stale-or-expired-lease")
    if kind == "heartbeat":
        record.expires_at = now + lease
        return answer("extended")
    if kind == "checkpoint":
        return answer("active", reason)
    if kind == "commit":
        record.completed, record.commit, record.token = True, request.get("commit"), None
        return answer("committed", record.commit or "")
    raise ValueError(f"requests are {', '.join(REQUESTS)}")


def reusable(record: Record) -> bool:
    return record.completed and not record.invalidated


ANSWERS = "revision_id string, seq long, request string, status string, reason string, token string, fence long"


def answered(record: Record, key: str, rows: pd.DataFrame, lease: int) -> list[tuple]:
    out = []
    for r in rows.sort_values("seq").to_dict("records"):
        request = {k: None if isinstance(v, float) and v != v else v for k, v in r.items()}
        a = apply(record, key, request, lease)
        out.append((key, int(r["seq"]), r["request"], a["status"], a["reason"], a["token"], a["fence"]))
    return out


def run_batch(requests: DataFrame, lease: int = LEASE) -> DataFrame:
    """Answers to requests (revision_id, seq, request, at, type, token, fence, commit): the requests of
    a revision are applied in the order of seq. They are a log of one revision, bounded by its life."""

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(answered(Record(), key[0], rows, lease), columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return requests.groupBy("revision_id").applyInPandas(group, ANSWERS)


def run_stream(requests: DataFrame, lease: int = LEASE, forget: int | None = None) -> DataFrame:
    """The same over a stream, in append mode, with the record as state. Within a micro-batch the order
    is that of seq, and micro-batches follow one another.

    forget: milliseconds of silence after which a revision's record is dropped. Choose them longer than any
    late event or retry may take: a dropped record starts anew, fence included. None keeps records for good.
    """

    def group(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        record = Record(**json.loads(state.get[0])) if state.exists else Record()
        rows = pd.concat(list(parts))
        out = answered(record, key[0], rows, lease)
        state.update((json.dumps(asdict(record)),))
        if forget is not None:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return requests.groupBy("revision_id").applyInPandasWithState(group, ANSWERS, "record string", "append", timeout)


def watched(beats: DataFrame, lease: int = LEASE, timeout: int = HEARTBEAT_TIMEOUT) -> DataFrame:
    """What became of a lease's heartbeats (revision_id, fence, granted_at, at, answered_at): `extended`,
    `timeout` if the answer took longer than the timeout or never came, `expired` if the heartbeat
    came when the lease had run out, and `lost` after either of these. Times are milliseconds."""
    own = Window.partitionBy("revision_id", "fence").orderBy("at", F.col("answered_at").asc_nulls_last())
    until = F.coalesce(F.lag("at").over(own), F.col("granted_at")) + lease
    late = F.coalesce(F.col("answered_at") - F.col("at") > timeout, F.lit(True))
    rows = beats.withColumn("status", F.when(F.col("at") >= until, "expired").when(late, "timeout").otherwise("extended"))
    lost = F.max((F.col("status") != "extended").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)) == 1
    return rows.withColumn("status", F.when(lost, "lost").otherwise(F.col("status")))


def in_time(started: Column, finished: Column, allowed: Column | int = OPERATION, deadline: Column | None = None) -> Column:
    """Whether an operation finished by what it is allowed after its start, and by an absolute deadline;
    one that never finished didn't."""
    by = started + allowed if deadline is None else F.least(started + allowed, deadline)
    return F.coalesce(finished <= by, F.lit(False))
