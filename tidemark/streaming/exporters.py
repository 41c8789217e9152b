"""Exporters of change streams: batches to files, at least once, resumed from a checkpoint.

Each micro-batch is written under its number, so a batch that is tried again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import delete_sweep


def message_records(events: DataFrame, table: str) -> DataFrame:
    """Keyed messages: an upsert holds the row as JSON, a delete is a tombstone; headers name version and source."""
    payload = [c for c in events.columns if not c.startswith("_")]
    value = F.when(F.col("_op") != "delete", F.to_json(F.struct(*payload)))

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    version = F.unhex(F.lpad(F.hex(F.col("_seq")), 16, "0"))  # eight bytes, big end first
    headers = F.array(header("htc-version", version), header("htc-source-table", F.lit(table).cast("binary")), header("content-type", F.lit("application/json").cast("binary")))
    return events.select(F.col("_key").cast("binary").alias("key"), value.cast("binary").alias("value"), headers.alias("headers"), "_seq")


def tombstones(known: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Messages that delete, after a reset, the keys that the new snapshot lacks."""
    return delete_sweep(known, snapshot, "_key").select(F.col("_key").cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"))


def replicate(events: DataFrame, source: str, condition: Column | None = None) -> DataFrame:
    """Events for another store: selected upserts and all deletes, stamped with their source."""
    from .watch import visible

    return visible(events, condition).withColumn("source", F.lit(source))


def export(events: DataFrame, path: str, checkpoint: str, transform=None, file_format: str = "json", **trigger) -> StreamingQuery:
    """Run an exporter over a stream of changes."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").format(file_format).save(f"{path}/batch={number:09d}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def lost(oldest_kept: int, cursor: int) -> int:
    """How many events a pruned log no longer has for a consumer at `cursor`."""
    return max(0, oldest_kept - cursor - 1)
