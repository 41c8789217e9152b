"""Archive tables: append-only, read newest first, partitioned by day so that time filters and retention prune files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


class Archive:
    """Rows below `root` with a time column in seconds since the epoch.

    An append is one batch of files; rows without a time are in day 0.  Within a file rows are sorted by time, so row
    groups have narrow ranges.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, time: str):
        self.spark, self.name, self.time, self.root = spark, name, time, f"{root.rstrip('/')}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def append(self, rows: DataFrame) -> None:
        day = F.coalesce(F.floor(F.col(self.time) / DAY), F.lit(0)).cast("int")
        batch = rows.withColumn("_day", day).withColumn("_batch", F.lit(uuid.uuid4().hex))
        batch.sortWithinPartitions("_day", self.time).write.mode("append").partitionBy("_day").parquet(self.root)

    def rows(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """Rows in [since, until); a day outside is not read."""
        fs, path = self._fs(self.root)
        if not fs.exists(path):
            return self.spark.createDataFrame([], f"{self.time} long")
        df = self.spark.read.parquet(self.root)
        if since is not None:
            df = df.filter((F.col("_day") >= since // DAY) & (F.col(self.time) >= since))
        if until is not None:
            df = df.filter((F.col("_day") <= until // DAY) & (F.col(self.time) < until))
        return df

    def newest(self, limit: int) -> DataFrame:
        """The latest rows, as a top-k."""
        return self.rows().orderBy(F.desc_nulls_last(self.time)).limit(limit)

    def days(self) -> list[tuple[int, int]]:
        """Days with their bytes, oldest first."""
        fs, path = self._fs(self.root)
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        out = [(int(p.getName()[5:]), fs.getContentSummary(p).getLength()) for p in found if p.getName().startswith("_day=")]
        return sorted(out)

    def retain(self, now: int, age: int = 0, most_bytes: int = 0, most_days: int = 0) -> list[int]:
        """Drop the oldest days until all limits hold (0: no limit); returns the days dropped."""
        kept, gone = self.days(), []
        while kept and (
            (age and (kept[0][0] + 1) * DAY <= now - age) or (most_bytes and sum(b for _, b in kept) > most_bytes) or (most_days and len(kept) > most_days)
        ):
            day = kept.pop(0)[0]
            fs, path = self._fs(f"{self.root}/_day={day}")
            fs.delete(path, True)
            gone.append(day)
        return gone
