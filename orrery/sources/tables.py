"""Tables in files, and small literal ones."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shots(spark: SparkSession, rows: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """shot_id, start, duration and premount of a few shots; ValueError for what can't be mounted."""
    for _, start, duration, premount in rows:
        if duration <= 0 or premount < 0 or max(abs(start - premount), abs(start + duration)) > (1 << 53) - 1:
            raise ValueError("a shot lasts, mounts ahead by zero or more, and stays within safe frames")
    return spark.createDataFrame(list(rows), "shot_id long, start long, duration long, premount long")


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of the machine's own only where all of Spark is
    one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="orrery-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A fresh path for files between steps, in the shared folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the session was made."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)


def kept(rows: DataFrame, adaptive: bool = True) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that steps after them don't repeat them.

    adaptive: whether Spark may plan anew on the way, which splits skewed joins and costs a job for each shuffle."""
    spark = rows.sparkSession
    shared_root(spark)
    key, was = "spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(key, str(adaptive and was == "true").lower())
    try:
        return rows.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(key, was)
