"""Whether evaluations repeat: one fingerprint for each address, however often it is evaluated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import number_key, record_hash


def context_key(frame: Column, absolute: Column, fps: Column, duration: Column, width: Column, height: Column) -> Column:
    """Text that tells evaluation contexts apart, zeros by sign included."""
    return F.concat_ws("|", *(number_key(c.cast("double")) for c in (absolute, duration, fps, frame, width, height)))


def drift(evaluations: DataFrame, address: Sequence[str], output: Sequence[str]) -> DataFrame:
    """address, number of evaluations and of distinct outputs, for those that didn't repeat.

    Outputs are compared by a digest of their canonical JSON, in which nulls stay; only the smallest
    and the largest digest of an address are shuffled before it is known whether they differ.
    """
    digest = F.sha2(F.to_json(F.struct(*output), {"ignoreNullFields": "false"}).cast("binary"), 256)
    found = evaluations.groupBy(*address).agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("low"), F.max(digest).alias("high"))
    return found.filter("low <> high").select(*address, "n")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two evaluations have the same rows, as often each."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def same_value(left: Column, right: Column) -> Column:
    """Whether two numbers are the same value: NaN is itself, and zeros are told apart by sign."""
    return number_key(left.cast("double")).eqNullSafe(number_key(right.cast("double")))


def disagreements(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key and columns in which two tables of records differ, deeply and whatever the order of fields; of
    keys that only one of them has, all columns. Records are compared by their hashes."""
    own = lambda rows: rows.select(*key, *(record_hash(rows, c).alias(c) for c in columns))
    a, b = own(left).alias("a"), own(right).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), differ.alias("differ")).filter(F.size("differ") > 0)
