"""Laws that a user adds, by kind, as table functions of SQL over Arrow batches.

    extensions.register(spark, "mine.sway", sway, {"x": "double"})
    spark.sql("SELECT * FROM law_mine_sway(TABLE(SELECT id, frame, fps, duration FROM places))")

A law's function takes the columns of a batch as numpy arrays, by name, and gives an array for each channel, as long as the
batch. The table that it is called with has an id (long), which comes back with the channels, and whatever columns the law
reads. Rows stay in the tasks where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import tables

Law = Callable[[Mapping[str, np.ndarray]], Mapping[str, np.ndarray]]
#: Kinds that sessions know, with the names of their functions.
KNOWN: dict[str, str] = {}


def function_name(kind: str) -> str:
    if not re.fullmatch(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", kind):
        raise ValueError(f"{kind!r} is no kind")
    return "law_" + re.sub(r"[.-]", "_", kind)


def register(spark: SparkSession, kind: str, law: Law, gives: Mapping[str, str]) -> str:
    """Makes a law known to SQL; the name of its function. gives: each channel's type."""
    from .catalogue import LAWS

    if kind in LAWS:
        raise ValueError(f"{kind} is a law of the library")
    if not gives or "id" in gives:
        raise ValueError("a law gives channels, none of them called id")
    name = function_name(kind)
    schema = T.StructType([T.StructField("id", T.LongType()), *T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in gives.items())).fields])
    arrow = to_arrow_schema(schema)

    class Evaluated:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "id"}
            made = law(columns)
            if set(made) != set(gives) or any(len(x) != batch.num_rows for x in made.values()):
                raise ValueError(f"{kind} has to give {', '.join(gives)}, a value for each row")
            yield pa.table([batch.column("id").cast(pa.int64()), *(pa.array(made[f.name]).cast(f.type) for f in list(arrow)[1:])], schema=arrow)

    tables.importable(spark)
    spark.udtf.register(name, F.arrow_udtf(Evaluated, returnType=schema))
    KNOWN[kind] = name
    return name


def channels(spark: SparkSession, kind: str, places: DataFrame) -> DataFrame:
    """id and the channels of a registered law at places (id and what the law reads); ValueError for a kind that none has."""
    if kind not in KNOWN:
        raise ValueError(f"no law {kind} is registered")
    return spark.sql(f"SELECT * FROM {KNOWN[kind]}(TABLE({{places}}))", places=places)
