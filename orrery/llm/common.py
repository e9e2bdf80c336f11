"""What the corpus operators share: tables, durable intermediate results and Arrow plumbing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts may be long, so batches stay far below Spark's default of 10,000 rows.
BATCH_ROWS = 512
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps Arrow batches small.

    The session's own settings are left alone where they are stricter.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_root(spark)}/orrery-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder; one of the machine's own only where all of Spark is one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-"))
        own = spark.sparkContext.getCheckpointDir()
    return (named or own).rstrip("/")


#: Spark's setting to remove what a finished execution has shuffled.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder: a lost executor loses none of them.

    What was shuffled on the way is of no more use, and Spark removes it as soon as the rows are kept.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    was = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(TIDY) if was is None else spark.conf.set(TIDY, was)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what an operator has written at a path of shared_dir() and no longer needs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(key: Column, divisor: int) -> Column:
    """crc32 of the key written as text, modulo divisor: the split into learning and held-out rows."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies fn to every batch."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run


HELD: dict = {}


def only(key: tuple, make: Callable[[], object]):
    """make(), kept for later tasks of the same Python worker, in place of what was kept before: workers
    live on from stage to stage, and their models and look-ups shouldn't add up. Operators that keep little
    call it too, so that the models of the stage before go."""
    if key not in HELD:
        HELD.clear()
        gc.collect()
        HELD[key] = make()
    return HELD[key]


def record(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
