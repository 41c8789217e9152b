"""Continuous aggregates: bucketed counts that are appended once their bucket is sealed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.timeline import bucket


class ContinuousAggregate:
    """COUNT, and SUM of `sums`, per bucket of `width` seconds of the time column and per label.

    A bucket is sealed when the watermark, `grace` seconds behind the latest event, passes its end: it is appended
    once and its state dropped.  Later rows for it are dropped and counted by the stream's progress.
    """

    def __init__(self, time: str, width: int, labels: list[str], grace: int = 0, sums: list[str] | None = None):
        self.time, self.width, self.labels, self.grace, self.sums = time, width, labels, grace, sums or []

    def _measures(self) -> list:
        return [F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"sum_{s}") for s in self.sums]]

    def rows(self, df: DataFrame) -> DataFrame:
        """All buckets of a finished input."""
        timed = df.filter(F.col(self.time).isNotNull())
        return timed.groupBy(bucket(F.col(self.time), self.width).alias("bucket"), *self.labels).agg(*self._measures())

    def stream(self, df: DataFrame) -> DataFrame:
        """The sealed buckets of a stream whose time column has seconds since the epoch."""
        at = F.timestamp_seconds(F.col(self.time)).alias("_at")
        timed = df.filter(F.col(self.time).isNotNull()).select("*", at).withWatermark("_at", f"{self.grace} seconds")
        out = timed.groupBy(F.window("_at", f"{self.width} seconds").alias("_w"), *self.labels).agg(*self._measures())
        return out.select(F.unix_timestamp("_w.start").alias("bucket"), *self.labels, "n", *[f"sum_{s}" for s in self.sums])

    def start(self, df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Append sealed buckets to Parquet at `path`; a restart goes on from `checkpoint`."""
        writer = self.stream(df).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their bucket was sealed, over the progress kept."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def expire(view: DataFrame, now: int, retention: int) -> DataFrame:
    """The buckets that a retention keeps."""
    return view.filter(F.col("bucket") >= now - retention) if retention else view
