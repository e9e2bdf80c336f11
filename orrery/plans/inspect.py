"""Facts about physical plans, to hold queries to: shuffles, joins, pushed filters, columns read."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Operators that compare every row with every other, or run Python on the executors.
QUADRATIC = ("BroadcastNestedLoopJoin", "CartesianProduct")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow")


@dataclass(frozen=True)
class Plan:
    text: str

    @property
    def operators(self) -> Counter:
        """How often each physical operator occurs."""
        names = re.findall(r"^[\s:|+*()\d-]*([A-Z]\w+)", self.text, re.M)
        return Counter(names)

    @property
    def shuffles(self) -> int:
        return self.operators["Exchange"]

    @property
    def quadratic(self) -> list[str]:
        return [n for n in QUADRATIC if self.operators[n]]

    @property
    def python(self) -> list[str]:
        return [n for n in PYTHON if self.operators[n]]

    @property
    def pushed(self) -> list[str]:
        """Filters that reach a scan."""
        return [f.strip() for part in re.findall(r"PushedFilters: \[([^\]]*)\]", self.text) for f in part.split(", ") if f.strip()]

    @property
    def columns_read(self) -> list[set[str]]:
        """The columns of each scan."""
        return [set(re.findall(r"(\w+):", part)) for part in re.findall(r"ReadSchema: struct<([^\n]*)>", self.text)]


def plan(df: DataFrame) -> Plan:
    return Plan(df._jdf.queryExecution().executedPlan().toString())


