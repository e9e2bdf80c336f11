"""The event log, the ledger and the stateful streams: restarts, replays, failures and the order of batches."""

from __future__ import annotations

import itertools
import json
import random
import time
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.outcome import NEGATIVE, SUCCESS
from orrery.sources import event_log, journal, ledger, tables
from orrery.streaming import authority, lease, outcome, sessions

EVENTS = "seq long, revision_id string, type string, value double"


@pytest.fixture()
def path(spark):
    event_log.register(spark)
    return tables.scratch(spark)


def events(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("seq"), (F.col("id") % 7).cast("string").alias("revision_id"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("type"), (F.col("id") / 2).alias("value"))


def append(spark, low, high, path):
    events(spark, low, high).repartition(3).write.format("event_log").mode("append").save(path)


def test_a_log_is_read_whole_and_by_conditions(spark, path):
    append(spark, 0, 100, path)
    append(spark, 100, 250, path)
    rows = spark.read.format("event_log").load(path)
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == [("seq", "bigint"), ("revision_id", "string"), ("type", "string"), ("value", "double")]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, events(spark, 0, 250).collect()), key=str)
    # A second query of the same DataFrame sees none of the first one's filter.
    assert rows.filter("revision_id = '3'").count() == 36 and rows.count() == 250
    asked = lambda *conditions: spark.read.format("event_log").option("where", event_log.where(*conditions)).load(path)
    for conditions, condition in (((("seq", ">", 40), ("seq", "<=", 120)), "seq > 40 AND seq <= 120"), ((("type", "=", "t1"),), "type = 't1'"), ((("type", "in", ["t1", "t2"]), ("value", ">=", 30.5)), "type IN ('t1', 't2') AND value >= 30.5"), ((("type", "not null", None), ("seq", "<", 50)), "type IS NOT NULL AND seq < 50")):
        assert sorted(r["seq"] for r in asked(*conditions).collect()) == sorted(r["seq"] for r in events(spark, 0, 250).filter(condition).collect())
    with pytest.raises(ValueError, match="comparisons"):
        event_log.where(("seq", "like", 3))
    with pytest.raises(Exception, match="no column"):
        asked(("nope", "=", 3)).count()
    with pytest.raises(Exception, match="no events yet"):
        spark.read.format("event_log").load(path + "/other").count()
    with pytest.raises(Exception, match="only appended to"):
        events(spark, 0, 1).write.format("event_log").mode("overwrite").save(path)
    empty = spark.read.format("event_log").schema(EVENTS).load(path + "/other")
    assert empty.count() == 0


def test_rows_of_a_failed_write_are_never_seen(spark, path):
    append(spark, 0, 10, path)
    broken = events(spark, 0, 100).withColumn("value", F.when(F.col("seq") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        broken.repartition(4, "seq").write.format("event_log").mode("append").save(path)
    assert spark.read.format("event_log").load(path).count() == 10
    log = journal.Journal(path)
    assert log.last() == 1
    with pytest.raises(FileExistsError):
        log.commit(1, {})
    append(spark, 10, 20, path)
    assert log.last() == 2 and spark.read.format("event_log").load(path).count() == 20


def test_a_stream_goes_on_where_it_stopped(spark, path):
    def run():
        stream = spark.readStream.format("event_log").load(path)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(f"{path}-out").awaitTermination()
        return sorted(r["seq"] for r in spark.read.schema(EVENTS).parquet(f"{path}-out").collect())

    append(spark, 0, 30, path)
    assert run() == list(range(30)) and run() == list(range(30))
    append(spark, 30, 40, path)
    append(spark, 40, 55, path)
    assert run() == list(range(55))
    since = spark.readStream.format("event_log").option("since", 2).load(path)
    since.writeStream.format("memory").queryName("since").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["seq"] for r in spark.table("since").collect()) == list(range(40, 55))


def test_a_micro_batch_that_comes_again_is_not_written_again(spark, path):
    append(spark, 0, 20, path)
    copy = f"{path}-copy"

    def run(progress):
        stream = spark.readStream.format("event_log").load(path)
        stream.writeStream.format("event_log").option("writer", "copier").option("checkpointLocation", progress).trigger(availableNow=True).start(copy).awaitTermination()
        return sorted(r["seq"] for r in spark.read.format("event_log").load(copy).collect())

    assert run(f"{path}-a") == list(range(20))
    # The checkpoint is lost: batch 0 runs again, and its rows are known.
    assert run(f"{path}-b") == list(range(20))
    append(spark, 20, 30, path)
    assert run(f"{path}-b") == list(range(30))
    # Nothing is left of the files that didn't count.
    named = {f for c in journal.Journal(copy).commits(0, journal.Journal(copy).last()) for f in c["files"]}
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{copy}/data").select("path").collect()
    assert {r["path"].rsplit("/", 1)[1] for r in there} == named


def entry(key, action, reason="r"):
    return (key, action, reason)


def merge(spark, path, rows, batch, writer="w", buckets=4):
    frame = spark.createDataFrame(rows, "key long, action string, reason string")
    ledger.dealt(frame, ["key"], buckets).write.format("decision_ledger").mode("append").options(keys="key", writer=writer, batch=batch).save(path)


def book(spark, path):
    rows = spark.read.format("decision_ledger").load(path).collect()
    assert len({(r["kind"], r["key"]) for r in rows}) == len(rows)
    return {(r["kind"][0], r["key"]): (r["action"], r["reason"], r["commit"]) for r in rows}


def test_a_ledger_merges_by_key_and_batch(spark, path):
    merge(spark, path, [entry(1, "wait"), entry(2, "save"), entry(3, "save"), entry(None, "wait")], 0)
    assert book(spark, path) == {("d", 1): ("wait", "r", 1), ("d", 2): ("save", "r", 1), ("d", 3): ("save", "r", 1), ("d", None): ("wait", "r", 1)}
    merge(spark, path, [entry(2, "discard", "revision.deleted"), entry(1, "save")], 1)
    after = book(spark, path)
    assert after == {("d", 1): ("save", "r", 2), ("d", 2): ("discard", "revision.deleted", 2), ("r", 2): ("discard", "revision.deleted", 2), ("d", 3): ("save", "r", 1), ("d", None): ("wait", "r", 1)}
    # Batches that come again change nothing, and leave no files.
    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data").count()
    before = files()
    merge(spark, path, [entry(3, "discard"), entry(9, "save")], 1)
    merge(spark, path, [entry(3, "discard")], 0)
    assert book(spark, path) == after and files() == before
    # A retraction stays, once, whatever comes later; another writer counts its own batches.
    merge(spark, path, [entry(2, "discard", "render.failed")], 0, writer="other")
    assert book(spark, path)[("r", 2)] == ("discard", "revision.deleted", 2) and book(spark, path)[("d", 2)][1] == "render.failed"
    with pytest.raises(Exception, match="keys"):
        spark.createDataFrame([entry(1, "wait")], "key long, action string, reason string").write.format("decision_ledger").mode("append").save(path)


def test_a_merge_holds_no_bucket_whole(spark):
    """Rows of a bucket without end come out merged as they come in."""
    kind = T.StructType.fromDDL("bucket int, __place string, key long, action string, reason string")
    merge = ledger.Merge(kind, {"path": "/nowhere", "keys": "key"})
    rows = lambda step, action, more: ({"__place": f"{i:09d}", "key": i, "action": action, "reason": "r"} | more for i in itertools.count(0, step))
    got = list(itertools.islice(merge.merged(rows(2, "save", {"kind": "decision", "commit": 1}), rows(3, "discard", {}), 2), 6))
    assert [(r["key"], r["kind"], r["action"], r["commit"]) for r in got] == [(0, "decision", "discard", 2), (0, "retraction", "discard", 2), (2, "decision", "save", 1), (3, "decision", "discard", 2), (4, "decision", "save", 1), (6, "decision", "discard", 2)]


def test_a_file_is_read_as_its_rows_are_asked_for(path):
    """However slowly rows are taken, no more than a few of 64 row groups are in memory."""
    schema, n = pa.schema([("key", pa.int64()), ("place", pa.string())]), 1 << 13
    part = lambda i: pa.RecordBatch.from_pydict({"key": list(range(i, i + n)), "place": [f"{k:080d}" for k in range(i, i + n)]}, schema)
    own = journal.Journal(path)
    name, total = own.stage((part(i * n) for i in range(64)), schema)
    before, held, rows = pa.total_allocated_bytes(), 0, []
    for batch in event_log.scanned(own, name, schema, None):
        if len(rows) < 4 * n:
            time.sleep(0.2)
        held = max(held, pa.total_allocated_bytes() - before)
        rows += batch["key"].to_pylist()
    assert rows == list(range(total)) and held < 16 * part(0).nbytes


def test_a_failed_merge_leaves_the_ledger_as_it_was(spark, path):
    merge(spark, path, [entry(i, "save") for i in range(20)], 0)
    before = book(spark, path)
    rows = ledger.dealt(spark.createDataFrame([entry(i, "discard") for i in range(20)], "key long, action string, reason string"), ["key"], 4)
    broken = rows.withColumn("reason", F.when(F.col("key") == 13, F.raise_error(F.lit("stop"))).otherwise(F.col("reason")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("decision_ledger").mode("append").options(keys="key", writer="w", batch=1).save(path)
    assert book(spark, path) == before
    # Rows of one bucket in two tasks can't be merged, and nothing counts.
    apart = rows.withColumn("bucket", F.lit(0)).repartition(3, "key")
    with pytest.raises(Exception, match="several tasks"):
        apart.write.format("decision_ledger").mode("append").options(keys="key", writer="w", batch=1).save(path)
    assert book(spark, path) == before
    merge(spark, path, [entry(1, "discard")], 1)
    assert book(spark, path)[("r", 1)][2] == 2


def test_late_negatives_by_hand(spark, path):
    """Any cut of the log into commits: the ledger has each revision's last decision, and what was saved and then not."""
    rng = random.Random(4)
    names = [*SUCCESS, "compile.succeeded", "render.succeeded", "compile.succeeded", "render.succeeded", "neutral", NEGATIVE[0], NEGATIVE[3]]
    rows = [(i, rng.randrange(12), rng.choice(names)) for i in range(150)]
    cuts = [0, 40, 95, 150]
    saved, taken, last = {}, {}, {}
    for low, high in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[low:high], "seq long, key long, type string").write.format("event_log").mode("append").save(f"{path}/log")
        live = outcome.decisions(spark.readStream.format("event_log").load(f"{path}/log"), ["key"], ["seq"])
        outcome.enter(live, ["key"], f"{path}/ledger", f"{path}/progress", buckets=3).awaitTermination()
        for key in {k for _, k, _ in rows[low:high]}:
            own = [t for _, k, t in rows[:high] if k == key]
            negative = next((t for t in own if t in NEGATIVE), None)
            success = next((s for s in SUCCESS if s in own), None)
            action = "discard" if negative else "save" if success and {"compile.succeeded", "render.succeeded"} <= set(own) else "wait"
            if last.get(key) == "save" and action == "discard":
                taken.setdefault(key, negative)
            last[key] = action
        saved = book(spark, f"{path}/ledger")
    assert {k: v[0] for (kind, k), v in saved.items() if kind == "d"} == last
    assert {k: v[1] for (kind, k), v in saved.items() if kind == "r"} == taken and taken


def followed(spark, path, rows, cuts, schema, stream):
    """What a stream has written after a run for each part of the rows, with its checkpoint kept between runs."""
    for low, high in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[low:high], schema).repartition(2).write.format("event_log").mode("append").save(f"{path}/log")
        made = stream(spark.readStream.format("event_log").load(f"{path}/log"))
        going = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/progress").trigger(processingTime="0 seconds").start(f"{path}/out")
        going.processAllAvailable()
        going.stop()
    return sorted((tuple(r) for r in spark.read.schema(made.schema).parquet(f"{path}/out").collect()), key=str)


@pytest.mark.parametrize("cuts", [[0, 60], [0, 13, 14, 40, 60]])
def test_expiry_is_told_by_a_timer_whatever_the_batches(spark, path, cuts):
    rng = random.Random(7)
    rows, now = [], 1000
    for _ in range(60):
        now += rng.choice((1, 5, 40, 130))
        rows.append((rng.choice("abc"), rng.randrange(1, 3), now, now + rng.choice((1, 1, 1, 30)) if rng.random() < 0.9 else None))
    first = {}
    for r in rows:
        first.setdefault(r[:2], r[2] - 10)
    rows = [(*r[:2], first[r[:2]], *r[2:]) for r in rows]
    want, end, fate = [], {}, defaultdict(str)
    for key, fence, granted, at, answered in rows:
        k = (key, fence)
        end.setdefault(k, granted + 100)
        if fate[k]:
            want.append((*k, at, "lost"))
        elif at >= end[k]:
            want += [(*k, end[k], "lapsed"), (*k, at, "expired")]
            fate[k] = "expired"
        elif answered is None or answered - at > 20:
            want.append((*k, at, "timeout"))
            fate[k] = "timeout"
        else:
            want.append((*k, at, "extended"))
            end[k] = at + 100
    # At the end of the log nothing more arrives, but the watermark has passed.
    want += [(*k, e, "lapsed") for k, e in end.items() if not fate[k] and e <= now - 3]
    schema = "revision_id string, fence long, granted_at long, at long, answered_at long"
    got = followed(spark, path, rows, cuts, schema, lambda s: authority.monitor(s, 100, 20, late="3 milliseconds"))
    assert got == sorted(want, key=str) and any(r[3] == "lapsed" for r in want)


@pytest.mark.parametrize("cuts", [[0, 80], [0, 30, 31, 80]])
def test_answers_of_the_authority_whatever_the_batches(spark, path, cuts):
    rng = random.Random(5)
    kinds, names = ["acquire", "acquire", "heartbeat", "checkpoint", "commit", "release"], ["workspace.exported", "compile.succeeded", "render.succeeded", "neutral"]
    rows, now = [], 1000
    for seq in range(80):
        now += rng.choice((1, 9, 60))
        key, kind = rng.choice("ab"), "event" if seq < 8 or rng.random() < 0.2 else rng.choice(kinds)
        fence = rng.randrange(1, 4)
        rows.append((key, seq, kind, now, (NEGATIVE[1] if seq > 60 and rng.random() < 0.3 else rng.choice(names)) if kind == "event" else None, f"lease-{key}-{fence}", fence, f"commit-{seq}"))
    want, records = [], defaultdict(lease.Record)
    columns = ("revision_id", "seq", "request", "at", "type", "token", "fence", "commit")
    for r in rows:
        request, record = dict(zip(columns, r, strict=True)), records[r[0]]
        if record.token and record.expires_at <= r[3]:
            want.append((r[0], record.expires_at, "timer", "expired", "", record.token, record.fence))
            record.token = None
        a = lease.apply(record, r[0], request, 100)
        want.append((r[0], r[1], r[2], a["status"], a["reason"], a["token"], a["fence"]))
    want += [(k, x.expires_at, "timer", "expired", "", x.token, x.fence) for k, x in records.items() if x.token and x.expires_at <= now - 3]
    schema = "revision_id string, seq long, request string, at long, type string, token string, fence long, commit string"
    got = followed(spark, path, rows, cuts, schema, lambda s: authority.authority(s, 100, late="3 milliseconds"))
    assert got == sorted(want, key=str)
    assert {"acquired", "expired", "stale", "committed"} <= {r[3] for r in want}


@pytest.mark.parametrize("cuts", [[0, 50], [0, 1, 20, 21, 50]])
def test_drift_is_told_once_whatever_the_batches(spark, path, cuts):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice(["x", None]), rng.randrange(2), float(rng.random() < 0.15)) for i in range(50)]
    first, told = {}, {}
    for seq, root, name, frame, out in rows:
        key = (root, json.dumps({"name": name, "frame": frame}, separators=(",", ":")))
        if first.setdefault(key, out) != out:
            told.setdefault(key, seq)
    got = followed(spark, path, rows, cuts, "seq long, root string, name string, frame long, out double", lambda s: sessions.drifts(s, F.col("root"), ["name", "frame"], "seq", ["out"]))
    assert {(r[0], r[1]): r[2] for r in got} == told and len(got) == len(told) and all(r[3] != r[4] for r in got)


class Counted:
    """A handle that holds one key's state and counts what is asked of it."""

    def __init__(self):
        self.held, self.timers, self.calls = {}, set(), []

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def get(self):
        return self.calls.append("get") or self.held.get("own")

    def update(self, value):
        self.calls.append("update")
        self.held["own"] = value

    def getValue(self, key):  # noqa: N802
        return self.calls.append("get") or self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls.append("update")
        self.held[key] = value

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("timer")
        self.timers.remove(at)


def test_state_is_read_and_written_once_for_all_rows_of_a_key():
    handle = Counted()
    beats = [Row(at=1000 + i, answered_at=1001 + i, granted_at=990) for i in range(50)]
    for part, calls in ((beats[:20], ["get", "timer", "update"]), (beats[20:], ["get", "timer", "timer", "update"])):
        monitor = authority.Monitor(100, 20)
        monitor.init(handle)
        handle.calls.clear()
        assert len(list(monitor.handleInputRows(("a", 1), iter(part), None))) == len(part) and handle.calls == calls
    assert handle.timers == {1149}
    handle = Counted()
    asked = [Row(at=1000 + i, seq=i, request="event", type=n, token=None, fence=None, commit=None) for i, n in enumerate(["neutral", *SUCCESS, "compile.succeeded", *NEGATIVE] * 5)]
    judge = authority.Authority(100)
    judge.init(handle)
    assert len(list(judge.handleInputRows(("a",), iter(asked), None))) == len(asked) and handle.calls == ["get", "update"]
    handle = Counted()
    seen = sessions.Verifier()
    seen.init(handle)
    runs = [Row(address="x", fingerprint=str(i // 3), seq=i) for i in range(9)]
    assert [r.seq for r in seen.handleInputRows(("a",), iter(runs), None)] == [3] and handle.calls == ["get", "update"]
