"""MinHash near-duplicate groups with tensored banding.

Two small collections of `tables` keys each are made per text, a key being `rows` MinHash values.  Every pair of a
key of the one and a key of the other is a hash table, so ``2 * tables * rows`` MinHash values serve
``tables ** 2`` tables of ``2 * rows`` values each: the computation is about the square root of that of
independent tables.  Texts that meet in a table are candidates and are verified on their full shingle sets.

A pair of similarity s is missed when it agrees in no key of one collection: at most ``2 * (1 - s**rows)**tables``,
which is 0.0005 at s = 0.75 for the defaults and 0.000001 at s = 0.9.

Texts whose shingle sets are equal, by a cryptographic digest of the sorted set, form a class and are linked without
a comparison; only one of each class goes on, known by a number of its own.  A table's bucket is never expanded into
pairs: first its members are compared with the bucket's first.  Buckets whose members then are in one component are
done.  Each other bucket is compared in one task, across components only, if it is small; buckets of equal members
once.  Texts of large open buckets are compared in blocks.  So no link that the tables find is lost to the grouping,
a bucket of copies costs one comparison a member, and what moves grows with the buckets' members.  Comparisons take
shingle hashes; texts travel once.

Nulls and texts without words have an empty set and link with nothing.  A text of fewer words than `width` has its
whole sequence as its one shingle.  Rows with a null id are dropped from the result's links but keep their row
(component null).  Rows that share an id are compared each by its own text.  Empty tables give
empty results.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .components import connected_components
from .scratch import Scratch, columns

U64 = np.uint64
#: Members, and their shingles, that one comparison task is meant to hold.
BLOCK, WEIGHT = 256, 1 << 19
_SIGNATURE = "id long, n_shingles long, set_a long, set_b long, left array<long>, right array<long>"


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, and n+1 offsets."""
    word, first = K.words(column)
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    value = np.zeros(len(word), U64)
    for k in range(min(width, len(word))):
        value[: len(word) - k] += word[k:] * U64((0xA24BAED4963EE407 * (2 * k + 1) + 2 * k) % (1 << 64) | 1)
    keep = np.arange(n.sum()) + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.zeros(0, int)
    out = K.mix(value[keep])
    short = np.flatnonzero((count > 0) & (count < width))
    at = np.concatenate(([0], np.cumsum(n)))
    for i in short:  # the whole sequence, marked by its length
        value, m = U64(0), int(count[i])
        for k, w in enumerate(word[first[i] : first[i + 1]].tolist()):
            value = U64((int(value) + w * ((0xC2B2AE3D27D4EB4F * (2 * k + 1) + 2 * k) | 1)) % (1 << 64))
        out[at[i]] = K.mix(np.array([(int(value) + m) % (1 << 64)], U64))[0]
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(out, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(n)))))


def _digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each set, as two numbers."""
    bounds = at.tolist()
    return np.frombuffer(b"".join(hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)), np.int64).reshape(-1, 2)


def _sets(width: int):
    """Rows (rep, set_a, set_b, text) to the shingles of each rep, once a task; other texts of the same id go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in K.chunks(batches, "text"):
            sets, at = shingle_sets(batch.column(3), width)
            rep, a, b = (batch.column(i).to_numpy() for i in range(3))
            digest = _digests(sets, at)
            keep = [i for i in np.flatnonzero((digest[:, 0] == a) & (digest[:, 1] == b)).tolist() if rep[i] not in seen and not seen.add(int(rep[i]))]
            yield pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array([sets[at[i] : at[i + 1]].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["rep", "shingles"])

    return run


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a column of shingles."""
    if not len(column):
        return []
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _signatures(width: int, rows: int, tables: int):
    half = rows * tables
    rng = np.random.default_rng(7)
    mult = rng.integers(0, 1 << 63, 2 * half, dtype=U64) * U64(2) + U64(1)
    plus = rng.integers(0, 1 << 63, 2 * half, dtype=U64)

    def keys(mins: np.ndarray) -> np.ndarray:  # (half, n) to (n, tables)
        out = np.zeros((tables, mins.shape[1]), U64)
        for r in range(rows):
            out = K.mix(out * U64(0x9FB21C651E98DF25) + mins[r::rows])
        return np.ascontiguousarray(out.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            sets, at = shingle_sets(batch.column(1), width)
            full = np.flatnonzero(np.diff(at))
            mins = np.zeros((2 * half, len(full)), U64)
            digest = np.zeros((batch.num_rows, 2), np.int64)
            if len(full):
                top = sets >> U64(1)
                for h in range(2 * half):
                    x = (top ^ plus[h]) * mult[h]
                    x ^= x >> U64(29)
                    mins[h] = np.minimum.reduceat(x, at[:-1][full])
                digest[full] = _digests(sets, at)[full]
            pair = []
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            offsets[1:] = np.cumsum((np.diff(at) > 0) * tables)
            for side in (mins[:half], mins[half:]):
                flat = keys(side).reshape(-1).view(np.int64)
                pair.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(at)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), *pair],
                names=["id", "n_shingles", "set_a", "set_b", "left", "right"],
            )

    return run


def _verify(threshold: Fraction):
    """Compare one text (rows with role 0) with the members of its block (role 1); emits linked pairs."""
    top, bottom = threshold.numerator, threshold.denominator

    def run(key, table):
        table = table.combine_chunks()
        src, dst = [], []
        lead: np.ndarray | None = None
        lead_id = key[0].as_py()
        roles = table.column("role").to_numpy()
        sets = _lists(table.column("shingles"))
        for i in np.flatnonzero(roles == 0)[:1]:
            lead = sets[i]
        members = np.flatnonzero(roles == 1)
        if lead is not None:
            for i in members:
                own = sets[i]
                where = np.searchsorted(lead, own)
                where[where == len(lead)] = len(lead) - 1
                both = int((lead[where] == own).sum())
                if bottom * both >= top * (len(lead) + len(own) - both):
                    src.append(lead_id)
                    dst.append(table.column("id")[int(i)].as_py())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _blocks(n: Column, shingles: Column) -> Column:
    """Blocks for so many sets of so many shingles in all."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / WEIGHT)).cast("int")


def _compare(pairs: DataFrame, sets: DataFrame, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """Of pairs (src, dst, size of dst), those that are similar.  A set that leads many pairs is copied once a block."""
    pairs = scratch.save(pairs.distinct(), "pairs")
    blocks = pairs.groupBy("src").agg(_blocks(F.count(F.lit(1)), F.sum("m")).alias("blocks"))
    placed = pairs.join(blocks, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int").alias("block"))
    member = placed.join(sets.withColumnRenamed("rep", "dst"), "dst").select(F.col("src").alias("lead"), "block", F.lit(1).alias("role"), F.col("dst").alias("id"), "shingles")
    lead = blocks.join(sets.withColumnRenamed("rep", "src"), "src").select(
        F.col("src").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("src").alias("id"), "shingles"
    )
    found = lead.unionByName(member).groupBy("lead", "block").applyInArrow(_verify(threshold), "src long, dst long")
    return scratch.save(found, "links")


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered `left` with those numbered `right`."""
    value, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.cumsum(count > 1) - 1
    kept = count[code] > 1
    code, owner = column[code[kept]], owner[kept]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float64)
    step = 8192
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(code, (lo, lo + step))
        dense = np.zeros((len(sets), step), np.float32)
        dense[owner[a:b], code[a:b] - lo] = 1
        out += dense[left] @ dense[right].T
    return out


def _between(threshold: Fraction):
    """Compare two blocks (side 0 and 1, or one block with itself) across components; emits a spanning forest."""
    top, bottom = threshold.numerator, threshold.denominator

    def run(key, table):
        table = table.combine_chunks()
        sets = _lists(table.column("shingles"))
        side = table.column("side").to_numpy()
        rep, c = table.column("rep").to_numpy(), table.column("c").to_numpy()
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(j):
            j = i
        size = np.array([len(x) for x in sets])
        both = _intersections(sets, i, j)
        alike = bottom * both >= top * (size[i][:, None] + size[j][None, :] - both)
        alike &= c[i][:, None] != c[j][None, :]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        src, dst = [], []
        for r, k in zip(*np.nonzero(alike), strict=True):
            a, b = root(int(c[i[r]])), root(int(c[j[k]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                src.append(rep[i[r]])
                dst.append(rep[j[k]])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _compare_small(rest: DataFrame, keys: DataFrame, sets: DataFrame, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """Links across components within each of some buckets, every bucket in one task."""
    members = rest.join(keys.select("key"), "key", "left_semi").select("key", "rep", "c", F.lit(0).alias("side"))
    return scratch.save(members.join(sets, "rep").groupBy("key").applyInArrow(_between(threshold), "src long, dst long"), "links")


def _compare_apart(rest: DataFrame, sets: DataFrame, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """Links across components among texts (rep, component c, m shingles) that share large buckets with `lead`.

    Texts connected by shared buckets form a family.  A family is cut into blocks of about BLOCK texts, whole
    components together unless they are larger, and each pair of blocks is compared as a product of incidence
    matrices; so a family of n texts sends each of them to n / BLOCK tasks and makes no rows for pairs.
    """
    family = connected_components(rest.select(F.col("lead").alias("src"), F.col("rep").alias("dst")), scratch).toDF("rep", "family")
    docs = scratch.save(rest.select("rep", "c", "m").distinct().join(family, "rep"), "families")
    size = docs.groupBy("family", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("w"))
    large = (F.col("n") >= BLOCK) | (F.col("w") >= WEIGHT)
    small = size.filter(~large).groupBy("family").agg(_blocks(F.sum("n"), F.sum("w")).alias("small"))
    size = scratch.save(size.join(small, "family", "left"), "sizes")
    docs = docs.join(size, ["family", "c"]).withColumn("of", F.when(large, F.col("c")))
    docs = docs.withColumn("block", F.when(large, F.pmod(F.xxhash64("rep"), _blocks(F.col("n"), F.col("w")))).otherwise(F.pmod(F.xxhash64("c"), F.col("small"))))
    docs = scratch.save(docs.select("family", "rep", "c", F.concat_ws("-", "of", "block").alias("block"), "of"), "blocks")
    block = docs.select("family", "block", "of").distinct()
    a, b = block.alias("a"), block.alias("b")
    pairs = a.join(b, "family").filter("a.block <= b.block and (a.of is null or b.of is null or a.of <> b.of)")
    pairs = scratch.save(pairs.select("family", F.col("a.block").alias("x"), F.col("b.block").alias("y")), "pairs")
    first = pairs.join(docs.withColumnRenamed("block", "x"), ["family", "x"]).withColumn("side", F.lit(0))
    second = pairs.filter("x < y").join(docs.withColumnRenamed("block", "y"), ["family", "y"]).withColumn("side", F.lit(1))
    sides = first.select("family", "x", "y", "side", "rep", "c").unionByName(second.select("family", "x", "y", "side", "rep", "c"))
    found = sides.join(sets, "rep").groupBy("family", "x", "y").applyInArrow(_between(threshold), "src long, dst long")
    return scratch.save(found, "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: Fraction = Fraction(3, 4),
    rows: int = 2,
    tables: int = 10,
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id reachable by links), kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash", quiet=True)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = scratch.save(docs.mapInArrow(_signatures(width, rows, tables), _SIGNATURE), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    # a class is a set of shingles; `first` is its smallest id, `rep` its number
    classes = signed.filter("n_shingles > 0 and id is not null").groupBy(*same).agg(
        F.min("id").alias("first"), F.min_by("left", "id").alias("left"), F.min_by("right", "id").alias("right")
    )
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    i, j = (F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias(x) for x in "ij")
    m = F.col("n_shingles").alias("m")
    keys = (
        classes.select("rep", m, "left", "right", i)
        .select("rep", "m", "right", F.col("i"), F.col("left")[F.col("i")].alias("a"), j)
        .select("rep", "m", F.xxhash64("i", "j", "a", F.col("right")[F.col("j")]).alias("key"))
    )
    lead = keys.groupBy("key").agg(F.min(F.struct("rep", "m")).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    lead = lead.select("key", F.col("lead.rep").alias("lead"), F.col("lead.m").alias("lead_m"), "n")
    members = scratch.save(keys.join(lead, "key").select("key", "rep", "m", "lead", "lead_m", "n"), "members")
    involved = classes.join(members.select("rep").distinct(), "rep").select(F.col("first").alias("id"), "rep", "set_a", "set_b")
    sets = scratch.save(docs.join(involved, "id").select("rep", "set_a", "set_b", "text").mapInArrow(_sets(width), "rep long, shingles array<long>"), "sets")

    # sets of very different sizes can't be similar
    possible = F.least("m", "lead_m") * threshold.denominator >= F.greatest("m", "lead_m") * threshold.numerator
    pairs = members.filter("rep <> lead").filter(possible).select(F.col("lead").alias("src"), F.col("rep").alias("dst"), "m")
    links = _compare(pairs, sets, threshold, scratch)
    component = connected_components(links, scratch)

    # buckets of more than two members that still are in several components
    own = component.withColumnRenamed("node", "rep")
    shared = members.filter("n > 2").join(own, "rep", "left").select("key", "rep", "m", "lead", F.coalesce("component", "rep").alias("c"))
    inside = [F.count(F.lit(1)).alias("n"), F.sum("m").alias("w"), F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("total")]
    split = shared.groupBy("key").agg(*inside).filter("low < high")
    split = scratch.save(split.groupBy("n", "w", "low", "high", "mark", "total").agg(F.min("key").alias("key")), "split")  # equal members once
    if not split.isEmpty():
        rest = scratch.save(shared.join(split.select("key"), "key", "left_semi"), "open")
        small = (F.col("n") <= BLOCK) & (F.col("w") <= WEIGHT)
        more = _compare_small(rest, split.filter(small), sets, threshold, scratch)
        wide = rest.join(split.filter(~small).select("key"), "key", "left_semi").select("rep", "m", "lead", "c").distinct()
        if not split.filter(~small).isEmpty():
            more = more.unionByName(_compare_apart(scratch.save(wide, "wide"), sets, threshold, scratch))
        component = connected_components(scratch.save(links.unionByName(more), "links"), scratch)

    found = classes.select(*same, "first", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*same, "first", F.coalesce("component", "rep").alias("component"))
    found = scratch.save(found, "found")
    low = found.groupBy("component").agg(F.min("first").alias("low"))
    out = signed.select("id", *same).join(found.join(low, "component").select(*same, "low"), same, "left")
    smallest = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", smallest.alias("component_id"), F.coalesce(F.col("id") == smallest, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row with the smallest id stays."""
    kept = near_duplicates(columns(docs, id_col, text_col), id_col, text_col, **options).filter("kept").select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(kept["_kept"]), "left_semi")
