"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that signs of the rotated coordinates make balanced binary codes
that lose little (iterative quantisation).  It is fitted on at most `sample` vectors, those with the smallest hash of
their id, and every vector is encoded with it.  A code of `bits` bits is cut into `tables` chunks, each the key of a
hash table; vectors of one label whose codes agree in a chunk, or differ there in one bit, are candidates, and are
linked if their cosine in double precision reaches the threshold.  At cosine 0.98 a bit differs with probability
0.064, so a pair is missed with probability 0.005 by the defaults, and less above.  None below is ever linked.
Vectors are scaled by a power of two first, so very large and very small ones neither overflow nor vanish, and the
cosine is one formula everywhere: products added in order, over the product of the norms.

Copies of one vector in one label, known by the SHA-256 of their components, are one class, linked without a
comparison.  Pairs of buckets with few pairs are
expanded; larger ones are compared as blocks of at most `BLOCK` vectors by a matrix product, which returns the
number of links of each vector and a spanning forest, so a dense group never makes a row per pair.  A pair is
counted in the first table that holds it.

Vectors that are null, empty, zero or hold nulls or non-finite numbers, and rows with a null label or id, link with
nothing: n_links 0 and the own id as component.  Vectors of different length never link.  Rows that share an id
share a component.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Vectors in a block; pairs of buckets with at most PAIRS pairs are expanded.
BLOCK, PAIRS = 512, 64
#: A matrix product is closer than this to the formula's cosine.
NEAR = 1e-9


def fit_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dim, bits) by PCA and iterative quantisation; more bits than dimensions take further
    rotations."""
    mean = x.mean(0)
    centred = x - mean
    dim = x.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred)
    rng = np.random.default_rng(seed)
    out = []
    left = bits
    while left > 0:
        k = min(dim, left)
        top = axes[:, ::-1][:, :k]
        v = centred @ top
        r, _ = np.linalg.qr(rng.standard_normal((k, k)))
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(top @ r)
        left -= k
    return mean, np.concatenate(out, 1)


_KEYED = "id long, label string, key binary, scaled array<double>"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, and for sound vectors their SHA-256 and the vector scaled so that its largest component is in
    [0.5, 1)."""
    for batch in batches:
        column = batch.column(2)
        at = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64) if len(column.values) else np.zeros(0)
        there = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        keys, scaled = [], []
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            x = flat[a:b]
            top = np.abs(x).max(initial=0.0) if there[i] else 0.0
            if 0 < top < np.inf:  # not with NaN, which nulls are here
                keys.append(hashlib.sha256((x + 0.0).tobytes()).digest())
                scaled.append(np.ldexp(x, -np.frexp(top)[1]))
            else:
                keys.append(None)
                scaled.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(scaled, pa.list_(pa.float64()))], names=["id", "label", "key", "scaled"])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, by the formula of the SQL side: products added in order."""

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in range(x.shape[1]):
            out += x[:, k] * y[:, k]
        return out

    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, with zeros up to `dim`."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(at)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)] = flat[at[0] : at[-1]]
    return out


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors as rows, with zeros up to `dim`."""
    out = _dense(column, dim)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _encode(mean: np.ndarray, projection: np.ndarray):
    weights = np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                unit = _padded(part.column(3), len(mean))
                code = (((unit - mean) @ projection >= 0) * weights).sum(1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(code.view(np.int64)), part.column(3)], names=["rep", "label", "mult", "code", "embedding"])

    return run


def _chunk(code: str | Column, t: int | str, width: int) -> Column:
    """Chunk t (a number or a column's name) of a code (a column or its name)."""
    x = F.col(code) if isinstance(code, str) else code
    shift = F.col(t) * F.lit(width) if isinstance(t, str) else F.lit(t * width)
    return F.call_function("shiftrightunsigned", x, shift.cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(threshold: float, width: int):
    """Compare two blocks (side 0 and 1 of table t; the same block if there is no side 1)."""
    low = np.uint64((1 << width) - 1)

    def near(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Where chunk t of the codes differs in at most one bit."""
        x = ((a[:, None] ^ b[None, :]) >> np.uint64(t * width)) & low
        return (x & (x - np.uint64(1)) * (x > 0)) == 0

    def run(key, table):
        t = key[1].as_py()
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        rep = table.column("rep").to_numpy()
        mult = table.column("mult").to_numpy()
        code = table.column("code").to_numpy().view(np.uint64)
        vectors = table.column("embedding").combine_chunks()
        size = np.diff(vectors.offsets.to_numpy())
        whole = _dense(vectors, int(size.max(initial=1)))
        unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
        i = np.flatnonzero(side == 0)
        j = np.flatnonzero(side == 1)
        alone = not len(j)
        if alone:
            j = i
        about = unit[i] @ unit[j].T
        found = (about >= threshold + NEAR) & (size[i][:, None] == size[j][None, :])
        r, c = np.nonzero((np.abs(about - threshold) < NEAR) & (size[i][:, None] == size[j][None, :]))
        for lo in range(0, len(r), 4096):  # decided by the formula
            a, b = r[lo : lo + 4096], c[lo : lo + 4096]
            found[a, b] = _cosines(whole[i[a]], whole[j[b]]) >= threshold
        for earlier in range(t):
            found &= ~near(code[i], code[j], earlier)
        if alone:
            found = np.triu(found, 1)
        counts = np.concatenate((found @ mult[j], found.T @ mult[i]))
        nodes = np.concatenate((rep[i], rep[j]))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        edges = []
        for r, c in zip(*np.nonzero(found), strict=True):
            a, b = root(int(rep[i[r]])), root(int(rep[j[c]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((a, b))
        seen = counts > 0
        n = int(seen.sum())
        return pa.table(
            {
                "rep": pa.array(np.concatenate((nodes[seen], np.array([a for a, _ in edges], np.int64))), pa.int64()),
                "links": pa.array(np.concatenate((counts[seen], np.zeros(len(edges), np.int64))), pa.int64()),
                "other": pa.array([None] * n + [b for _, b in edges], pa.int64()),
            }
        )

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, bits: int = 64, tables: int = 4, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    width = bits // tables
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    rows = scratch.save(rows.mapInArrow(_keyed, _KEYED), "rows")
    classes = rows.filter("key is not null").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("scaled").alias("embedding"))
    classes = scratch.save(classes.select("rep", "label", "key", "mult", "embedding"), "classes")
    dim = classes.agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    if dim is None:  # nothing can link
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    sample = max(256, min(sample, (64 << 20) // (8 * dim)))
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()
    mean, projection = fit_rotation(_padded(chosen.column(0).combine_chunks(), dim), bits)
    kind = "rep long, label string, mult long, code long, embedding array<double>"
    coded = scratch.save(classes.select("rep", "label", "mult", "embedding").mapInArrow(_encode(mean, projection), kind), "codes")

    # a bucket is a label, a table and a chunk's value; large ones are cut into blocks
    member = coded.select("rep", "label", "mult", "code", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
    member = member.withColumn("v", _chunk("code", "t", width))
    bucket = scratch.save(member.groupBy("label", "t", "v").agg(F.count(F.lit(1)).alias("n")), "buckets")
    flips = F.explode(F.array(*[F.lit(1 << k).cast("long") for k in range(width)]))
    other = bucket.select("label", "t", F.col("v").alias("w"), F.col("n").alias("m"))
    apart = bucket.withColumn("flip", flips).withColumn("w", F.col("v").bitwiseXOR(F.col("flip"))).filter("v < w").drop("flip").join(other, ["label", "t", "w"])
    pairs = apart.select("label", "t", "v", "n", "w", "m").unionByName(bucket.filter("n > 1").select("label", "t", "v", "n", F.col("v").alias("w"), F.col("n").alias("m")))
    pairs = scratch.save(pairs, "pairs")

    def sided(x: DataFrame, prefix: str, key: str) -> DataFrame:
        return x.select("label", "t", F.col("v").alias(key), *[F.col(c).alias(prefix + c) for c in ("rep", "mult", "code")])

    # few pairs: by rows
    few = pairs.filter(F.col("n") * F.col("m") <= PAIRS).select("label", "t", "v", "w")
    rows_ab = few.join(sided(member, "a_", "v"), ["label", "t", "v"]).join(sided(member, "b_", "w"), ["label", "t", "w"])
    rows_ab = rows_ab.filter((F.col("v") < F.col("w")) | (F.col("a_rep") < F.col("b_rep")))
    for t in range(tables - 1):
        x = _chunk(F.col("a_code").bitwiseXOR(F.col("b_code")), t, width)
        rows_ab = rows_ab.filter((F.col("t") <= t) | (F.bit_count(x) > 1))
    unit = coded.select("rep", "embedding")
    ab = rows_ab.select("a_rep", "a_mult", "b_rep", "b_mult").join(unit.toDF("a_rep", "a"), "a_rep").join(unit.toDF("b_rep", "b"), "b_rep")

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    cosine = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    linked = scratch.save(ab.filter((F.size("a") == F.size("b")) & (cosine >= threshold)).select("a_rep", "a_mult", "b_rep", "b_mult"), "linked")

    # many pairs: by blocks
    many = pairs.filter(F.col("n") * F.col("m") > PAIRS).withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mb", F.ceil(F.col("m") / BLOCK).cast("int"))
    tasks = many.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    tasks = scratch.save(tasks.filter("v < w or i <= j").select("label", "t", "v", "w", "i", "j", "nb", "mb"), "tasks")
    parts = []
    whole = coded.select("rep", "label", "mult", "code", "embedding", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t")).withColumn("v", _chunk("code", "t", width))
    if not tasks.isEmpty():
        wanted = tasks.select("label", "t", "v").union(tasks.select("label", "t", "w")).distinct()
        whole = scratch.save(whole.join(wanted, ["label", "t", "v"], "left_semi"), "members")
        for side, v, block, blocks in ((0, "v", "i", "nb"), (1, "w", "j", "mb")):
            mine = tasks if side == 0 else tasks.filter("v < w or i < j")
            own = whole.withColumnRenamed("v", v)
            hit = mine.join(own, ["label", "t", v]).filter(F.pmod(F.xxhash64("rep"), F.col(blocks)) == F.col(block))
            parts.append(hit.select("label", "t", "v", "w", "i", "j", F.lit(side).alias("side"), "rep", "mult", "code", "embedding"))
        blocks_ = parts[0].unionByName(parts[1]).groupBy("label", "t", "v", "w", "i", "j").applyInArrow(_blocks(threshold, width), "rep long, links long, other long")
        blocks_ = scratch.save(blocks_, "blocks")
    else:
        blocks_ = spark.createDataFrame([], "rep long, links long, other long")

    counted = linked.select(F.col("a_rep").alias("rep"), F.col("b_mult").alias("links")).unionByName(linked.select(F.col("b_rep").alias("rep"), F.col("a_mult").alias("links"))).unionByName(blocks_.select("rep", "links"))
    counted = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = linked.select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst")).unionByName(blocks_.filter("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    component = connected_components(edges, scratch).toDF("rep", "component")
    found = classes.join(counted, "rep", "left").join(component, "rep", "left")
    found = scratch.save(found.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "found")
    out = rows.drop("scaled").join(found, ["label", "key"], "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), links.alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
