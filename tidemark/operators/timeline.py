"""Reading a change log: the state at a time, versions with their intervals, and series over them.

A change log has a key, an order and a time per event; see :mod:`tidemark.sources.changelog`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: list[str], until: Column | None = None, op: str | None = None) -> DataFrame:
    """The last event of each key, optionally among those where `until` holds; keys deleted last are left out.

    One aggregation with a map-side combine: a key with very many versions is reduced before the shuffle.  Each column
    is an aggregate of its own, so columns that nobody asks for are not read.  The order must have no ties in a key.
    """
    if until is not None:
        log = log.filter(until)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    out = log.groupBy(key).agg(*[F.max_by(f"`{c}`", at).alias(c) for c in log.columns if c != key])
    return out.filter((F.col(op) != "delete") | F.col(op).isNull()) if op else out


def versions(log: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Every event with the time at which the next of its key supersedes it (null for the live one)."""
    return log.withColumn("superseded_at", F.lead(at).over(Window.partitionBy(key).orderBy(*order)))


def gauge_series(intervals: DataFrame, start: str, end: str, width: int, by: list[str] | None = None, value: Column | None = None) -> DataFrame:
    """How many intervals [start, end) hold at each bucket boundary, per group: bucket, groups, active.

    Each interval adds one where it begins to count and takes one where it ends; a running sum gives the series.
    The sum runs over the buckets of a group, of which there are few, not over the events.
    """
    by = by or []
    amount = value if value is not None else F.lit(1)

    def first(c: str) -> Column:  # the first boundary at or after a time
        return (F.ceil(F.col(c) / width) * width).cast("long")

    opens = intervals.select(*by, first(start).alias("bucket"), amount.alias("d"))
    closes = intervals.filter(F.col(end).isNotNull()).select(*by, first(end).alias("bucket"), (-amount).alias("d"))
    steps = opens.unionByName(closes).groupBy(*by, "bucket").agg(F.sum("d").alias("d"))
    running = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, "bucket", F.sum("d").over(running).alias("active"))


def bucket(at: Column, width: int) -> Column:
    """The bucket that a time in seconds falls into; also right before the epoch."""
    return (F.floor(at / width) * width).cast("long")
