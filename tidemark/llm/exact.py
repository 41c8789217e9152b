"""Exact duplicates by counting quotient filters, confirmed on bytes.

Texts are compared after deleting every character of ``[\\x20\\x09-\\x0D]``.  Each partition puts its texts'
64-bit fingerprints (the head of their SHA-256) into counting quotient filters: the leading bits choose the filter
and the quotient inside it, what remains is stored, sorted, under its quotient, with a count.  Filters of all
partitions merge without loss by merging sorted remainders and adding counts.  Only texts whose fingerprint has a
merged count above one travel on; there they are grouped by their bytes.

Of equal texts the row with the most code points in the original text stays, then that with the smallest id.
Null texts count as empty; empty texts are equal to one another.  A null id loses against any other.  Ids are
expected to be distinct: rows that repeat the staying row's id are marked kept as well, and `keep_one` keeps one
of them.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .scratch import Scratch

U64 = np.uint64
#: Fingerprints that one merged filter is meant to hold.
FILTER_ROWS = 1 << 20


class CountingQuotientFilter:
    """Fingerprints of `bits` bits with counts.

    `runs` has the number of remainders under each of the ``2**quotient_bits`` quotients, `remainders` has them in
    order, and `many` has position and count of the fingerprints that occur more than once.
    """

    def __init__(self, bits: int, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, many: np.ndarray):
        self.bits, self.quotient_bits, self.runs, self.remainders, self.many = bits, quotient_bits, runs, remainders, many

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int, quotient_bits: int) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        values, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
        values = values[first]
        counts = np.add.reduceat(counts, first) if len(first) else counts
        rest = U64(bits - quotient_bits)
        runs = np.bincount((values >> rest).astype(np.int64), minlength=1 << quotient_bits).astype(np.uint32)
        at = np.flatnonzero(counts > 1)
        return cls(bits, quotient_bits, runs, values & ((U64(1) << rest) - U64(1)), np.stack([at, counts[at]], 1).astype(np.int64))

    def counts(self) -> np.ndarray:
        out = np.ones(len(self.remainders), np.int64)
        out[self.many[:, 0]] = self.many[:, 1]
        return out

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.runs), dtype=U64), self.runs)
        return quotient << U64(self.bits - self.quotient_bits) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all fingerprints of `filters`, which must agree in their parameters."""
        one = filters[0]
        return cls.build(np.concatenate([x.fingerprints() for x in filters]), np.concatenate([x.counts() for x in filters]), one.bits, one.quotient_bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self.remainders), len(self.many)], np.int64)
        occupied = np.packbits(self.runs > 0)
        ends = np.zeros(len(self.remainders), bool)
        ends[np.cumsum(self.runs)[self.runs > 0] - 1] = True
        width = -(-(self.bits - self.quotient_bits) // 8)
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join(x.tobytes() for x in (head, occupied, np.packbits(ends), np.ascontiguousarray(packed), self.many))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, n, m = np.frombuffer(data, np.int64, 4).tolist()
        raw, at = np.frombuffer(data, np.uint8), 32
        size = -(-(1 << quotient_bits) // 8)
        occupied = np.unpackbits(raw[at : at + size])[: 1 << quotient_bits].astype(bool)
        at += size
        ends = np.flatnonzero(np.unpackbits(raw[at : at + -(-n // 8)])[:n])
        at += -(-n // 8)
        width = -(-(bits - quotient_bits) // 8)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = raw[at : at + n * width].reshape(n, width)
        at += n * width
        runs = np.zeros(1 << quotient_bits, np.uint32)
        runs[occupied] = np.diff(np.concatenate(([-1], ends)))
        return cls(bits, quotient_bits, runs, remainders.reshape(-1).view("<u8").astype(U64), np.frombuffer(data, np.int64, 2 * m, at).reshape(m, 2))


def _normalised(with_text: bool):
    """id, code points, SHA-256 and fingerprint of the text without white space; with the text itself if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            raw, at = K.buffers(batch.column(1))
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            keep = ~K._SPACE[raw]
            new_at = np.concatenate(([0], np.cumsum(keep)))[at]
            data = raw[keep].tobytes()
            ends = new_at.tolist()
            shas = [hashlib.sha256(data[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            fingerprint = np.frombuffer(b"".join(shas), ">i8")[::4].astype(np.int64)
            out = {
                "id": batch.column(0),
                "points": pa.array((points[at[1:]] - points[at[:-1]]).astype(np.int64)),
                "sha": pa.array([x.hex() for x in shas], pa.string()),
                "fingerprint": pa.array(fingerprint),
            }
            if with_text:
                out["normal"] = pa.Array.from_buffers(pa.large_string(), len(shas), [None, pa.py_buffer(new_at.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def _filters(block_bits: int, quotient_bits: int):
    """One filter a block over all fingerprints of a partition, which are sorted once."""
    bits = 64 - block_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.column(0).to_numpy().view(U64) for batch in batches]
        value = np.sort(np.concatenate(held)) if held else np.zeros(0, U64)
        block = (value >> U64(bits) if block_bits else value * U64(0)).astype(np.int64)
        bounds = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(value)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            mine = value[a:b] & U64((1 << bits) - 1)
            one = CountingQuotientFilter.build(mine, np.ones(len(mine), np.int64), bits, quotient_bits)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block[a]], pa.int32()), "filter": pa.array([one.to_bytes()], pa.binary())})

    return run


def _repeated(block_bits: int):
    """Merge a block's filters; emit the fingerprints with a count above one."""
    bits = 64 - block_bits

    def run(key, table):
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()])
        at = merged.many[:, 0]
        value = merged.fingerprints()[at] | U64(((key[0].as_py() << bits) if block_bits else 0) % (1 << 64))
        return pa.table({"fingerprint": pa.array(value.view(np.int64)), "count": pa.array(merged.many[:, 1].copy(), pa.int64())})

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = "id long, points long, sha string, fingerprint long"
    light = scratch.save(docs.mapInArrow(_normalised(False), kind), "fingerprints")
    rows = light.count()
    block_bits = max(0, (max(rows, 1) // FILTER_ROWS).bit_length())
    quotient_bits = 12
    filters = light.select("fingerprint").mapInArrow(_filters(block_bits, quotient_bits), "block int, filter binary")
    repeated = scratch.save(filters.groupBy("block").applyInArrow(_repeated(block_bits), "fingerprint long, count long"), "repeated")

    # byte verification: only these texts travel
    suspects = docs.mapInArrow(_normalised(True), f"{kind}, normal string").join(repeated, "fingerprint", "left_semi")
    groups = suspects.groupBy("sha", "normal").agg(F.max(F.struct("points", F.bitwise_not("id").alias("order"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch.save(groups.select("sha", F.bitwise_not("best.order").alias("keep"), "group_size"), "groups")

    out = light.join(groups, "sha", "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (single | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay.  Rows are known by id and text, so texts that share an id are told apart, and of
    rows that repeat both one stays."""
    found = exact_duplicates(docs, id_col, text_col)
    gone = found.filter("not kept").select(F.col(id_col).alias("_gone"), "text_sha256").distinct()
    normal = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")
    marked = docs.withColumn("_sha", F.sha2(normal, 256))
    same = F.col(f"`{id_col}`").eqNullSafe(gone["_gone"]) & (F.col("_sha") == gone["text_sha256"])
    return marked.join(gone, same, "left_anti").dropDuplicates([id_col, "_sha"]).drop("_sha")
