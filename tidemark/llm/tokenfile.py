"""Token ids in binary files that are read document by document.

A file is a run of independent Zstandard frames, each with its own content checksum, with whole documents in order;
a document longer than a frame has frames to itself.  Ids are little-endian unsigned integers of 2 or 4 bytes.  Two
skippable frames follow, so any Zstandard tool can read the file:

- the document index: a Zstandard frame of the header (version, bytes an id, documents) and for each document its
  id, whether the id is there at all, and how many ids it has;
- the seek table of the public seekable format: compressed size, raw size and checksum (low 32 bits of XXH64 of the
  raw bytes) of each data frame and of the index, and a footer.

A reader seeks to the end, reads the table and the index, and decompresses the frames it needs.

Ids are 2 bytes wide if the tokenizer's vocabulary fits, else 4; one that doesn't fit its width is an error.
Documents are written in ascending id order, null ids first, rows that share an id by a hash of their text; null texts are empty and hold
the end id alone.  Files hold ranges of ids, and `start` counts the ids of all documents before, over all files.  A
file appears under its name when it is whole, and a task that is tried again replaces it.  Empty tables make no
file and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernels as K
from .files import AtomicOutput, open_input
from .scratch import Scratch, parts, total_bytes
from .tokens import END, encoder, ids_crc32

# Fixed values of the public Zstandard formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 256 << 10
#: Files whose starts are summed together.
RUN = 1024
_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")


class TokenFileWriter:
    """Writes documents in the order given."""

    def __init__(self, out, width: int = 2, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.kind, self.frame_bytes = out, np.dtype(f"<u{width}"), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.pending: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.kind.itemsize} bytes")
        data = ids.astype(self.kind).tobytes()
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        for at in range(0, len(data), self.frame_bytes):
            part = data[at : at + self.frame_bytes]
            self.pending.append(part)
            self.size += len(part)
            if self.size >= self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        if raw:
            frame = self.zstd.compress(raw)
            self.out.write(frame)
            self.table.append(_ENTRY.pack(len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def finish(self) -> None:
        self._flush()
        there = np.array([x is not None for x in self.doc_ids], np.uint8)
        index = struct.pack("<BBQ", 1, self.kind.itemsize, len(self.counts)) + there.tobytes()
        index += np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes()
        packed = self.zstd.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        self.table.append(_ENTRY.pack(len(packed) + 8, 0, xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF))
        body = b"".join(self.table) + _FOOTER.pack(len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)


class TokenFileReader:
    """Random access by document number; `stream` is seekable."""

    def __init__(self, stream, size: int):
        self.stream = stream
        self.zstd = zstandard.ZstdDecompressor()
        stream.seek(size - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        stream.seek(size - _FOOTER.size - n * _ENTRY.size)
        table = np.frombuffer(stream.read(n * _ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        self.table = table[:-1]
        self.file_at = np.concatenate(([0], np.cumsum(table[:-1, 0])))
        self.raw_at = np.concatenate(([0], np.cumsum(table[:-1, 1])))
        stream.seek(int(self.file_at[-1]) + 8)
        packed = stream.read(int(table[-1, 0]) - 8)
        if xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF != table[-1, 2]:
            raise ValueError("the document index has a wrong checksum")
        index = self.zstd.decompress(packed)
        version, width, docs = struct.unpack_from("<BBQ", index)
        if version != 1:
            raise ValueError(f"unknown version {version}")
        self.kind = np.dtype(f"<u{width}")
        there = np.frombuffer(index, np.uint8, docs, 10)
        ids = np.frombuffer(index, "<i8", docs, 10 + docs).tolist()
        self.doc_ids = [i if t else None for i, t in zip(ids, there.tolist(), strict=True)]
        self.counts = np.frombuffer(index, "<u8", docs, 10 + 9 * docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self._held: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self.stream.seek(int(self.file_at[k]))
            raw = self.zstd.decompress(self.stream.read(int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k}: wrong checksum")
            self._held = k, raw
        return self._held[1]

    def read(self, number: int) -> np.ndarray:
        """Ids of one document; only the frames it lies in are decompressed."""
        lo, hi = (int(x) * self.kind.itemsize for x in self.starts[number : number + 2])
        k = int(np.searchsorted(self.raw_at, lo, "right")) - 1
        out = []
        while lo < hi:
            base = int(self.raw_at[k])
            take = self._frame(k)[lo - base : hi - base]
            out.append(take)
            lo += len(take)
            k += 1
        return np.frombuffer(b"".join(out), self.kind)


def _write(tokenizer: str, root: str, width: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{root}/part-{part:06d}.tok"
        out = writer = None
        try:
            for batch in K.chunks(batches, "text"):
                if writer is None:
                    out = AtomicOutput(path)
                    writer = TokenFileWriter(out, width or (2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4))
                flat, at = encoder(tokenizer).encode(batch.column(1))
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    writer.add(doc, flat[at[i] : at[i + 1]])
            if writer is None:
                return
            writer.finish()
        except BaseException:
            if out is not None:
                out.abandon()
            raise
        out.commit()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "bytes": [out.size], "docs": [len(writer.counts)], "tokens": [sum(writer.counts)]})

    return run


def write_token_files(docs: DataFrame, root: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 32 << 20, width: int | None = None) -> DataFrame:
    """Encode all texts, with the end id after each, and write them below `root` in ascending id order.

    Returns the files written: part, path, bytes, docs, tokens.  `file_bytes` is the text meant for one file.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n = parts(docs.sparkSession, total_bytes(docs), file_bytes)
    docs = docs.withColumn("tie", F.xxhash64("text"))  # so that rows of one id, or of none, needn't share a file
    ordered = docs.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie", "text").drop("tie")
    return ordered.mapInArrow(_write(tokenizer, root, width), "part long, path string, bytes long, docs long, tokens long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f in batch.to_pylist():
            with open_input(f["path"]) as stream:
                reader = TokenFileReader(stream, f["bytes"])
                for lo in range(0, len(reader.doc_ids), 1000):
                    some = range(lo, min(lo + 1000, len(reader.doc_ids)))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([reader.doc_ids[i] for i in some], pa.int64()),
                            "start": pa.array([f["start"] + int(reader.starts[i]) for i in some], pa.int64()),
                            "ids": pa.array([reader.read(i).astype("<i4") for i in some], pa.list_(pa.int32())),
                        }
                    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        ids = batch.column(2)
        at = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array([ids_crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_token_files(files: DataFrame, digest: bool = False) -> DataFrame:
    """The documents of the files of :func:`write_token_files`: doc_id, start and ids, or with `digest` n_tokens and
    ids_crc32 in place of the ids."""
    run = files.withColumn("run", F.floor(F.col("part") / RUN))
    runs = run.groupBy("run").agg(F.sum("tokens").alias("tokens"))  # a row for RUN files
    runs = runs.select("run", F.coalesce(F.sum("tokens").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = run.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(runs, "run").withColumn("start", F.col("start") + F.col("base")).drop("run", "base")
    spread = placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    if digest:
        return spread.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return spread.mapInArrow(_read, "doc_id long, start long, ids array<int>")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to token files, read them back, and return doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "tokens")
    files = scratch.save(write_token_files(docs, scratch.path("files"), tokenizer, id_col, text_col), "manifest")
    return read_token_files(files, digest=True)


__all__ = ["END", "TokenFileReader", "TokenFileWriter", "read_token_files", "token_digests", "write_token_files"]
