"""Copies of a whole catalogue, and followers of a change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .changelog import ChangeLog


def _tool(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return p.getFileSystem(conf), p, conf


def snapshot(spark: SparkSession, root: str, target: str, name: str, keep: int = 3) -> list[str]:
    """Copy all tables below `root` to `target`/`name`; the `keep` last by name stay.  Returns their names."""
    fs, source, conf = _tool(spark, f"{root.rstrip('/')}/tables")
    to_fs, to, _ = _tool(spark, f"{target.rstrip('/')}/{name}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, to, False, True, conf)
    to_fs, base, _ = _tool(spark, target)
    have = sorted(s.getPath().getName() for s in to_fs.listStatus(base))
    for old in have[:-keep]:
        to_fs.delete(_tool(spark, f"{target.rstrip('/')}/{old}")[1], True)
    return have[-keep:]


def restore(spark: SparkSession, snapshot_path: str, root: str) -> None:
    """Put a snapshot in place of an empty catalogue."""
    to_fs, to, conf = _tool(spark, f"{root.rstrip('/')}/tables")
    if to_fs.exists(to):
        raise ValueError("restore only into an empty catalogue")
    fs, source, _ = _tool(spark, snapshot_path)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, to, False, True, conf)


def apply_events(log: ChangeLog, events: DataFrame, cursor: int, at: float | None = None) -> int:
    """Apply a source's events later than `cursor` to a follower's log; returns the new cursor.

    A reset event deletes what the follower has; what comes after it counts.
    """
    fresh = events.filter(F.col("_seq") > cursor)
    last, reset = fresh.agg(F.max("_seq"), F.max(F.when(F.col("_op") == "reset", F.col("_seq")))).first()
    if last is None:
        return cursor
    log.create()
    changes = fresh.filter(F.col("_op").isin("upsert", "delete"))
    if reset is not None:
        changes = changes.filter(F.col("_seq") > reset)
        old = log.rows().drop("_seq", "_ts").withColumn("_op", F.lit("delete"))
        if not old.isEmpty():
            log.append(old, at)
    renamed = changes.withColumn("_order", F.col("_seq") - cursor - 1).drop("_seq", "_ts")
    if not renamed.isEmpty():
        log.append(renamed, at)
    return last
