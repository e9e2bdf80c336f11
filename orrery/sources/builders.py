"""Builders of authored scenes, as data: which parts a scene has, what they show, and which laws move them.

Style values of the parts (geometry, paint, type) aren't part of the table; give them as props.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .scenes import NODES

PART = re.compile(r"(?P<role>\w+) (?P<kind>[\w.-]+)(?: < (?P<parent>\w+))?(?: \* (?P<times>\w+))?(?: = (?P<shows>\w+))?")
LAWS = "node_id long, ord int, law string"


@dataclass(frozen=True)
class Builder:
    name: str
    parameters: tuple[str, ...]
    kind: str
    parts: tuple[dict[str, str | None], ...]
    laws: tuple[tuple[str, str], ...]


@lru_cache(1)
def builders() -> dict[str, Builder]:
    found = {}
    listed = lambda cell, mark: tuple(x.strip() for x in cell.split(mark) if x.strip())
    for line in Path(__file__).with_suffix(".txt").read_text().splitlines():
        if line and not line.startswith("#"):
            name, parameters, kind, parts, laws = (x.strip() for x in (line + " ").split("|"))
            made = []
            for part in listed(parts, ";"):
                if not (m := PART.fullmatch(part)):
                    raise ValueError(f"{name}: {part!r} is no part")
                made.append(m.groupdict())
            found[name] = Builder(name, listed(parameters, ","), kind, tuple(made), tuple(tuple(x.split()) for x in listed(laws, ";")))
    return found


def rows(name: str, /, **given: Any) -> tuple[list[tuple], list[tuple]]:
    """(nodes, laws) of a scene, numbered in the order of the table; ValueError for a builder or a
    parameter that isn't known, or missing."""
    own = builders().get(name)
    if own is None:
        raise ValueError(f"there is no builder {name!r}")
    if set(given) != set(own.parameters):
        raise ValueError(f"{name} takes {', '.join(own.parameters) or 'no parameters'}")
    nodes: list[tuple] = [(0, None, 0, own.kind, {"role": "self"})]
    at: dict[str, list[int]] = {"self": [0]}
    below: dict[int, int] = {}
    for part in own.parts:
        parents = at[part["parent"] or "self"]
        times = part["times"]
        n = 1 if times is None else int(times) if times.isdigit() else len(given[times])
        at[part["role"]] = []
        for i in range(n):
            parent = parents[i] if len(parents) == n else parents[0]
            props = {"role": part["role"], "index": str(i)}
            if part["shows"]:
                value = given[part["shows"]]
                props["shows"] = str(value[i] if isinstance(value, list | tuple) and i < len(value) else value)
            at[part["role"]].append(len(nodes))
            nodes.append((len(nodes), parent, below.setdefault(parent, 0), part["kind"], props))
            below[parent] += 1
    laws = []
    for role, law in own.laws:
        for i, node in enumerate(at[role]):
            laws.append((node, len(laws), re.sub(r"\{(\w+)\}", lambda m: str(i) if m[1] == "i" else str(given[m[1]]), law)))  # noqa: B023
    return nodes, laws


def build(spark: SparkSession, name: str, /, **given: Any) -> tuple[DataFrame, DataFrame]:
    """The nodes and the laws of a scene as tables."""
    nodes, laws = rows(name, **given)
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(laws, LAWS)
