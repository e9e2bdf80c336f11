"""Decisions about revisions as their events arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import outcome
from ..sources import ledger


def decisions(events: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "type") -> DataFrame:
    """The decision of every revision that has had events, in update mode: a row whenever it may have
    changed. The state of a revision is four small aggregates, however many events it has had; a stream
    has no order of its own, so the first negative event is the least by the order columns."""
    return outcome.decide(events, keys, order, kind)


def upsert(stream: DataFrame, keys: Sequence[str], write: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hands each micro-batch's decisions to `write`, which has to be idempotent by key: a batch that is
    run again after a failure brings the same rows. With no trigger, all that is there and then stops."""

    def batch(rows: DataFrame, number: int) -> None:
        write(rows.withColumn("batch", F.lit(number)))

    writer = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def enter(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str, buckets: int = ledger.BUCKETS, **trigger) -> StreamingQuery:
    """Merges decisions into a ledger, see sources.ledger, whose sources have to be registered: a batch that is run
    again changes nothing, and a decision that is taken back leaves a retraction."""

    def batch(rows: DataFrame, number: int) -> None:
        merged = ledger.dealt(rows, list(keys), buckets).write.format("decision_ledger").mode("append")
        merged.options(keys=",".join(keys), writer=checkpoint, batch=number).save(path)

    writer = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, at: str, kind: str, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by kind in windows of event time; what is later than `late` no longer counts."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), kind).count()
