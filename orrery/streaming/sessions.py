"""Whether evaluations repeat, as they come in: the stream of `operators.determinism`."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from .authority import framed, rows_of, store

DRIFTS = "root string, address string, seq long, wanted string, got string"


class Verifier(StatefulProcessor):
    """Of a root, the first fingerprint of each address, and whether its drift has been told."""

    def __init__(self, forget: int | None = None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "address string", "fingerprint string, told boolean", self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        out, seen, changed = [], {}, {}
        for r in rows_of(rows, "seq"):
            address = r["address"]
            if address not in seen:
                seen[address] = self.known.getValue((address,))
            before = seen[address]
            if before is None:
                seen[address] = (r["fingerprint"], False)
            elif before[0] != r["fingerprint"] and not before[1]:
                out.append((key[0], address, int(r["seq"]), before[0], r["fingerprint"]))
                seen[address] = (before[0], True)
            else:
                continue
            changed[address] = seen[address]
        for address, now in changed.items():
            self.known.updateValue((address,), now)
        yield from framed(out, DRIFTS)

    def close(self) -> None:
        pass


def fingerprint(*output: str) -> Column:
    return F.sha2(F.to_json(F.struct(*output), {"ignoreNullFields": "false"}).cast("binary"), 256)


def drifts(evaluations: DataFrame, root: Column, address: Sequence[str], seq: str, output: Sequence[str], forget: int | None = None) -> DataFrame:
    """root, address (JSON), seq, wanted and got: the first evaluation of each address that didn't repeat its first one,
    told at once and once only. An address that has drifted keeps its first fingerprint.

    forget: milliseconds of silence after which an address may start anew."""
    store(evaluations.sparkSession)
    rows = evaluations.select(root.cast("string").alias("root"), F.to_json(F.struct(*address), {"ignoreNullFields": "false"}).alias("address"), F.col(seq).cast("long").alias("seq"), fingerprint(*output).alias("fingerprint"))
    return rows.groupBy("root").transformWithState(Verifier(forget), DRIFTS, "Append", "None" if forget is None else "ProcessingTime")
