"""Where an engine without a place of its own keeps its tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def workspace(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share, deleted when the driver exits;
    in local mode, where that is unset, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tidemark-"))
            atexit.register(shutil.rmtree, _local[0], True)
        root = f"file://{_local[0]}"
    path = f"{root.rstrip('/')}/tidemark-engine-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass
