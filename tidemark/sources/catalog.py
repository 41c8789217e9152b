"""Definitions that last: a small file for each view, archive and index."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import SparkSession


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _path(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/{quote(name, safe='')}.txt"

    def put(self, kind: str, name: str, text: str) -> None:
        fs, path = self._fs(self._path(kind, name))
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def remove(self, kind: str, name: str) -> None:
        fs, path = self._fs(self._path(kind, name))
        fs.delete(path, False)

    def all(self, kind: str) -> dict[str, str]:
        """Names and texts."""
        fs, path = self._fs(f"{self.root}/{kind}")
        out = {}
        for s in fs.listStatus(path) if fs.exists(path) else []:
            name = s.getPath().getName()
            if name.endswith(".txt"):
                stream = fs.open(s.getPath())
                try:
                    out[unquote(name[:-4])] = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
        return out
