"""Sharding by a k-d tree over metadata, with DataFrame functions only.

The law is `bytes`: shards have sizes as near to equal as whole groups of equal texts allow, and equal texts share a
shard.  Groups are the tree's points, weighted by their bytes.  A cell that is to hold k shards is split at the
weighted quantile k//2 : k of the dimension along which it is widest, until every leaf holds one shard's bytes.
Along a dimension, points are ordered by its value and, where values tie, by a hash of the text, so that a value
with most of the bytes can be split as well.  Quantiles are found from distributed histograms: 256 values of each
dimension, then twice 4,096 slices of the hash inside the value where the quantile falls; so at most
``shards * 4096`` rows reach the driver at a time, whatever the input.  A group larger than an even share gets a
shard of its own (fewer than `shards` groups can be), and the rest is divided evenly over the others.

Null texts have no bytes and count as equal to empty ones; null metadata is a value of its own.  A row's size is its
text's bytes in UTF-8 plus 16.  Slots number a shard's rows from 0 without gaps.  Repeated rows get a slot each.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bytes counted for a row besides its text.
ROW_BYTES = 16
_SLICES = 4096


@dataclass
class _Cell:
    """A node: its leaves are shards first to first + leaves - 1."""

    number: int
    first: int
    leaves: int
    split: tuple[int, int, int] | None = None  # dimension, value, hash: what lies below goes left
    left: _Cell | None = None
    right: _Cell | None = None

    def place(self, dims: list[str], of: str) -> Column:
        if self.left is None or self.right is None:
            return F.lit(getattr(self, of))
        d, value, cut = self.split
        below = (F.col(dims[d]) < value) | ((F.col(dims[d]) == value) & (F.col("h") < cut))
        return F.when(below, self.left.place(dims, of)).otherwise(self.right.place(dims, of))

    def open(self) -> list[_Cell]:
        if self.left is None or self.right is None:
            return [self] if self.leaves > 1 else []
        return self.left.open() + self.right.open()


def _crossing(sums: dict[int, int], target: int, before: int) -> tuple[int, int]:
    """The first slice at which the running sum exceeds `target`, and the sum before it."""
    last = 0
    for k in sorted(sums):
        if before + sums[k] > target:
            return k, before
        before += sums[k]
        last = k
    return last + 1, before


def _grow(units: DataFrame, dims: list[str], root: _Cell) -> None:
    """Split all open cells, level by level."""
    numbers = root.number
    width: dict[int, int] = {}
    while cells := root.open():
        place = root.place(dims, "number").alias("cell")
        bins = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.col(x).alias("v")) for k, x in enumerate(dims)])).alias("b")
        rows = units.select(place, "w", bins).groupBy("cell", "b.d", "b.v").agg(F.sum("w").alias("w")).collect()
        held: dict[tuple[int, int], dict[int, int]] = {}
        for r in rows:
            held.setdefault((r["cell"], r["d"]), {})[r["v"]] = r["w"]
        for k in range(len(dims)):
            width.setdefault(k, max((max(v) - min(v) for (_, d), v in held.items() if d == k), default=0))
        todo = {}
        for c in cells:
            mine = [held.get((c.number, k), {}) for k in range(len(dims))]
            wide = [(max(v) - min(v)) / max(1, width[k]) if v else 0 for k, v in enumerate(mine)]
            d = wide.index(max(wide))
            total = sum(mine[d].values())
            target = total * (c.leaves // 2) // c.leaves
            value, before = _crossing(mine[d], target, 0)
            todo[c.number] = [c, d, value, target, before, 0]
        for shift in (12, 0):
            inside = [(F.col("cell") == n) & (F.col(dims[d]) == value) & (F.shiftright("h", shift + 12) == F.shiftright(F.lit(cut), shift + 12) if shift == 0 else F.lit(True)) for n, (_, d, value, _, _, cut) in todo.items()]
            sliced = units.select("*", place).filter(reduce(Column.__or__, inside))
            rows = sliced.groupBy("cell", F.shiftright("h", shift).alias("slice")).agg(F.sum("w").alias("w")).collect()
            for n, t in todo.items():
                sums = {r["slice"]: r["w"] for r in rows if r["cell"] == n}
                at, before = _crossing(sums, t[3], t[4])
                if shift == 0 and t[3] - before > before + sums.get(at, 0) - t[3]:
                    at += 1  # the nearer side of the last slice
                t[4], t[5] = before, at << shift
        for c, d, value, _, _, cut in todo.values():
            c.split = (d, value, cut)
            half = c.leaves // 2
            c.left, c.right = _Cell(numbers + 1, c.first, half), _Cell(numbers + 2, c.first + half, c.leaves - half)
            numbers += 2


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    `metadata` columns are cut into 256 values by a hash; the text's size, in sixteenths of powers of two, is the
    last dimension.
    """
    scratch = Scratch(docs.sparkSession, "kdshard")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    light = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.sha2(text, 256).alias("key"),
        *[F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(256)).cast("int").alias(f"m{k}") for k, c in enumerate(metadata)],
    )
    light = scratch.save(light, "rows")
    dims = [f"m{k}" for k in range(len(metadata))] + ["magnitude"]
    units = light.groupBy("key").agg(F.sum("size").alias("w"), F.min("size").alias("size"), F.min("crc").alias("crc"), *[F.min(d).alias(d) for d in dims[:-1]])
    units = units.select("key", "w", *dims[:-1], F.least(F.floor(F.log2("size") * 16), F.lit(255 + 64)).cast("int").alias("magnitude"), F.shiftrightunsigned(F.xxhash64("key", "crc"), 40).cast("int").alias("h"))
    units = scratch.save(units, "units")
    total = units.agg(F.sum("w").alias("w")).first()["w"] or 0

    large: dict[str, int] = {}
    left, bytes_left = shards, total
    while total and left > 1:
        more = units.filter((F.col("w") * left > bytes_left) & ~F.col("key").isin(list(large))).select("key", "w").collect()  # fewer than `left` rows
        if not more or len(more) >= left:
            break
        for r in sorted(more, key=lambda r: (-r["w"], r["key"])):
            left -= 1
            bytes_left -= r["w"]
            large[r["key"]] = left
    rest = units.filter(~F.col("key").isin(list(large))) if large else units
    root = _Cell(0, 0, left)
    if total:
        _grow(rest, dims, root)
    place = root.place(dims, "first")
    for key, number in large.items():
        place = F.when(F.col("key") == key, F.lit(number)).otherwise(place)

    placed = light.select("id", "size", "crc", "key").join(units.select("key", place.cast("int").alias("shard")), "key")
    # a slot is the rank inside a piece of the shard, after the rows of the pieces before it
    pieces = max(8, light.count() // (shards * 50_000))
    placed = scratch.save(placed.withColumn("piece", F.pmod(F.xxhash64("id", "key"), F.lit(pieces)).cast("int")), "placed")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n")).select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("id", "key"))
    return placed.withColumn("rank", rank).join(starts, ["shard", "piece"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
