"""Shared intermediate storage, and small helpers that every operator here uses.

Intermediates that are read more than once, or that cut a lineage, are written as Parquet below the folder
named by ``spark.checkpoint.dir``, which the driver and all executors share.  A lost executor then costs its
running tasks only.  In local mode an unset folder falls back to a temporary one; on a cluster that is refused.

For a `file:` folder Hadoop sets the mode of each file and folder by starting a command.  Until the new process runs
it, it has all of the JVM's memory, and whoever adds up an executor's processes counts that twice.  An operator whose
executors hold much memory can have its intermediates written by the Python workers, which start nothing.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import AtomicOutput, locate

_local_roots: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, when unset, a temporary folder for this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir before starting a local cluster")
    if not _local_roots:
        _local_roots.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _local_roots[0], True)
    return f"file://{_local_roots[0]}"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Keep Arrow batches to about `size` bytes, unless the session has a bound of its own, so that a Python worker's
    memory doesn't grow with the length of texts."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(size))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of what runs inside as soon as it has ended."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


#: Bytes of rows in a row group that a Python worker writes.
_GROUP = 8 << 20


def _writing(folder: str):
    """Rows to a Parquet file a task, named for the try; emits its name, none without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
        batches = (x for x in batches if x.num_rows)
        first = next(batches, None)
        if first is None:
            return
        out = AtomicOutput(f"{folder}/{name}")
        try:
            with pq.ParquetWriter(out.stream, first.schema) as writer:
                held, size = [first], first.nbytes
                for batch in batches:
                    if size >= _GROUP:
                        writer.write_table(pa.Table.from_batches(held))
                        held, size = [], 0
                    held.append(batch)
                    size += batch.nbytes
                writer.write_table(pa.Table.from_batches(held))
        except BaseException:
            out.abandon()
            raise
        out.commit()
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


class Scratch:
    """A folder of intermediates for one operator call; dropped explicitly or when the driver exits.

    With `quiet`, intermediates in a `file:` folder are written by the Python workers.
    """

    def __init__(self, spark: SparkSession, name: str, quiet: bool = False):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._quiet = quiet and self.root.startswith("file:")
        bound_batches(spark)
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and return it as read back.  The path is kept as ``scratch_path`` for :meth:`drop`.

        Nothing reads the write's shuffles after it, so they don't stay on the executors' disks until the driver
        happens to collect its garbage.
        """
        path = self.path(name)
        with _brief_shuffles(self.spark):
            if self._quiet:
                self._write(df, path)
            else:
                df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _write(self, df: DataFrame, path: str) -> None:
        """Of tasks that are tried more than once, only what the one try that counts has written gets to `path`."""
        tries = f"{path}-tries"
        names = df.mapInArrow(_writing(tries), "name string").collect()
        system, folder = locate(path)
        system.create_dir(folder, recursive=True)
        for row in names:
            system.move(f"{locate(tries)[1]}/{row['name']}", f"{folder}/{row['name']}")

    def drop(self, *saved: DataFrame | str) -> None:
        for x in saved:
            self._delete(x if isinstance(x, str) else x.scratch_path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except Exception:  # the JVM may be gone already
                pass


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that other columns of the input can't clash with names used inside."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of a text column over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]


def parts(spark: SparkSession, size: int, target: int = 16 << 20) -> int:
    """How many partitions hold `size` bytes at `target` bytes each; never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target), 1)
