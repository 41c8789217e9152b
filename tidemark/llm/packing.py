"""Packing documents into sequences of at most `capacity` tokens with a grouping genetic algorithm.

Texts are encoded with the end id after each.  A document longer than a sequence is cut into pieces of `capacity`
ids, of which the first may be shorter; nothing else is cut.  Pieces that fill a sequence get one to themselves.

The rest is dealt by a hash into groups of about `group_size` pieces.  For every group several islands evolve
packings.  A chromosome is a list of bins, not of pieces: crossover injects whole well-filled bins of one parent
into the other, drops the bins that share a piece with them, and places the displaced pieces by best fit, longest
first.  Mutation opens the emptiest bins and a few others and fills bins anew with the piece that is longest and the
others whose sum comes nearest to the space left.  Between epochs the best packing of each island migrates to the next.  An
island stops at the lower bound ``ceil(tokens / capacity)``.  Then the emptiest bins of up to 32 groups are opened
and packed anew together, until one group is left, so that groups waste no more than a few bins in all.

Null texts are empty and hold the end id alone.  Repeated rows are packed each.  Rows with a null id keep it.
Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernels as K
from .scratch import Scratch
from .tokens import encoder, ids_crc32

#: Groups whose emptiest bins are packed together, and bins that each gives.
FAN_IN, OPENED = 32, 16
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def best_fit(lengths: list[int], order: list[int], bins: list[list[int]], space: list[int], capacity: int) -> None:
    """Put pieces into the fullest bin that holds them, or into a new one."""
    by_space: dict[int, list[int]] = {}
    mask = 0
    for b, s in enumerate(space):
        by_space.setdefault(s, []).append(b)
        mask |= 1 << s
    for i in order:
        n = lengths[i]
        fits = mask >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            held = by_space[s]
            b = held.pop()
            if not held:
                mask ^= 1 << s
            bins[b].append(i)
        else:
            b, s = len(bins), capacity
            bins.append([i])
            space.append(s)
        s -= n
        space[b] = s
        by_space.setdefault(s, []).append(b)
        mask |= 1 << s


def fullest(lengths: list[int], items: list[int], space: int) -> list[int]:
    """Of the items those with the largest sum of lengths that is at most `space`."""
    reach, steps = 1, [1]
    mask = (1 << space + 1) - 1
    for i in items:
        reach |= reach << lengths[i] & mask
        steps.append(reach)
        if reach >> space:
            break
    total, out = reach.bit_length() - 1, []
    for k in range(len(steps) - 1, 0, -1):
        if not steps[k - 1] >> total & 1:
            out.append(items[k - 1])
            total -= lengths[items[k - 1]]
    return out


class GroupingGA:
    """Packs one group.  A packing is (bins, free space of each)."""

    def __init__(self, lengths: list[int], capacity: int, seed: int, population: int = 6, generations: int = 12):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.size, self.generations = population, generations
        big = sum(2 * n > capacity for n in lengths)
        self.bound = max(-(-sum(lengths) // capacity), big)

    def _pack(self, order: list[int]) -> tuple[list[list[int]], list[int]]:
        bins: list[list[int]] = []
        space: list[int] = []
        best_fit(self.lengths, order, bins, space, self.capacity)
        return bins, space

    def fitness(self, packing) -> tuple[int, int]:
        """Fewer bins, then more unequal fill (squares of free space), is better."""
        return -len(packing[0]), sum(s * s for s in packing[1])

    def seeds(self) -> list:
        """Best fit in descending order, and in slightly shuffled descending orders."""
        n = len(self.lengths)
        out = [self._pack(sorted(range(n), key=lambda i: (-self.lengths[i], i)))]
        while len(out) < self.size and len(out[0][0]) > self.bound:
            noise = 0.02 * self.capacity * len(out)
            key = [-x + self.random.uniform(-noise, noise) for x in self.lengths]
            out.append(self._pack(sorted(range(n), key=key.__getitem__)))
        return out

    def cross(self, a, b):
        """Inject the better-filled half of a random stretch of b's bins into a."""
        lo = self.random.randrange(len(b[0]))
        some = [(lo + k) % len(b[0]) for k in range(max(1, len(b[0]) // 4))]
        some.sort(key=b[1].__getitem__)
        gift = some[: max(1, len(some) // 2)]
        taken = {i for k in gift for i in b[0][k]}
        bins, space = [b[0][k][:] for k in gift], [b[1][k] for k in gift]
        loose: list[int] = []
        for items, s in zip(*a, strict=True):
            if taken.isdisjoint(items):
                bins.append(items[:])
                space.append(s)
            else:
                loose += [i for i in items if i not in taken]
        best_fit(self.lengths, sorted(loose, key=lambda i: (-self.lengths[i], i)), bins, space, self.capacity)
        return bins, space

    def mutate(self, a):
        """Open the emptiest bins and a few others, and fill bins from their pieces, each as full as it can be."""
        order = sorted(range(len(a[0])), key=lambda k: -a[1][k])
        open_ = set(order[:3]) | {self.random.randrange(len(order)) for _ in range(max(2, len(order) // 50))}
        bins = [x[:] for k, x in enumerate(a[0]) if k not in open_]
        space = [s for k, s in enumerate(a[1]) if k not in open_]
        loose = [i for k in open_ for i in a[0][k]]
        loose.sort(key=lambda i: -self.lengths[i] + self.random.uniform(0, 0.03 * self.capacity))
        while loose:
            first = loose.pop(0)
            others = fullest(self.lengths, loose, self.capacity - self.lengths[first])
            gone = set(others)
            loose = [i for i in loose if i not in gone]
            bins.append([first, *others])
            space.append(self.capacity - self.lengths[first] - sum(self.lengths[i] for i in others))
        return bins, space

    def evolve(self, migrants: list):
        people = migrants + self.seeds()
        people = sorted(people, key=self.fitness, reverse=True)[: self.size]
        for _ in range(self.generations):
            if len(people[0][0]) <= self.bound:
                break
            children = []
            for _ in range(self.size):
                a, b = (min(self.random.sample(range(len(people)), min(2, len(people)))) for _ in range(2))
                child = self.cross(people[a], people[b])
                children.append(self.mutate(child) if self.random.random() < 0.8 else child)
            people = sorted(people + children, key=self.fitness, reverse=True)[: self.size]
        return people[0]


def _to_array(packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(packing[0]):
        for i in items:
            out[i] = b
    return out


def _from_array(bins_of: list[int], lengths: list[int], capacity: int):
    bins: list[list[int]] = [[] for _ in range(max(bins_of, default=-1) + 1)]
    for i, b in enumerate(bins_of):
        bins[b].append(i)
    return bins, [capacity - sum(lengths[i] for i in x) for x in bins]


def _epoch(capacity: int, epoch: int):
    """Evolve islands: rows of group, island, lengths, and the bins of own and migrated elite (null at first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                ga = GroupingGA(lengths, capacity, hash((row["group"], row["island"], epoch)) & 0xFFFFFFFF)
                migrants = [_from_array(row[x], lengths, capacity) for x in ("own", "guest") if row[x]]
                best = ga.evolve(migrants)
                yield pa.RecordBatch.from_pylist(
                    [{"group": row["group"], "island": row["island"], "lengths": lengths, "own": _to_array(best, len(lengths)), "bins": len(best[0]), "waste": -ga.fitness(best)[1]}],
                    pa.schema([("group", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("own", pa.list_(pa.int32())), ("bins", pa.int32()), ("waste", pa.int64())]),
                )

    return run


def _evolve(pieces: DataFrame, capacity: int, islands: int, epochs: int, scratch: Scratch) -> DataFrame:
    """Pack the pieces (uid, group, length) of each group; returns uid, group, length, bin."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct("uid", "length")
    groups = scratch.save(pieces.groupBy("group").agg(F.array_sort(F.collect_list(item)).alias("items")), "groups")
    lengths = F.transform("items", lambda x: x["length"].cast("int")).alias("lengths")
    none = F.lit(None).cast("array<int>")
    state = groups.select("group", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), lengths, none.alias("own"), none.alias("guest"))
    kind = "group long, island int, lengths array<int>, own array<int>, bins int, waste long"
    for epoch in range(epochs):
        if epoch:
            guests = state.select("group", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("own").alias("guest"))
            state = state.join(guests, ["group", "island"]).select("group", "island", "lengths", "own", "guest")
        state = scratch.save(state.repartition(n, "group", "island").mapInArrow(_epoch(capacity, epoch), kind), "islands")
    best = state.groupBy("group").agg(F.min_by("own", F.struct("bins", "waste", "island")).alias("own"))
    placed = groups.join(best, "group").select("group", F.explode(F.arrays_zip("items", "own")).alias("x"))
    return scratch.save(placed.select(F.col("x.items.uid").alias("uid"), "group", F.col("x.items.length").alias("length"), F.col("x.own").alias("bin")), "packed")


def pack(pieces: DataFrame, capacity: int, scratch: Scratch, group_size: int = 4096, islands: int = 2, epochs: int = 2) -> DataFrame:
    """Sequences for pieces (uid long, distinct; length, at most `capacity`): uid, sequence_id.

    Sequence numbers are distinct by construction: even ones come from the uid of a full piece, odd ones from level,
    group and bin.
    """
    small = pieces.filter(F.col("length") < capacity).select("uid", F.col("length").cast("long").alias("length"))
    groups = max(1, -(-small.count() // group_size))
    level = 0
    left = small.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long"))
    done = pieces.filter(F.col("length") >= capacity).select("uid", (F.col("uid") * 2).alias("sequence_id"))
    while True:
        packed = _evolve(left, capacity, islands, epochs, scratch)
        if level >= 16 or groups >= 1 << 36:
            raise ValueError("too many pieces to number their sequences")
        number = ((F.lit(level).cast("long") * (1 << 36) + F.col("group")) * (1 << 20) + F.col("bin")) * 2 + 1
        key = F.when(F.col("bin") < 1 << 20, number).otherwise(F.raise_error(F.lit("a group has too many bins"))).alias("sequence_id")
        if groups == 1:
            break
        fill = packed.groupBy("group", "bin").agg(F.sum("length").alias("fill"))
        rank = F.row_number().over(Window.partitionBy("group").orderBy("fill", "bin"))
        opened = fill.withColumn("r", rank).filter((F.col("r") <= OPENED) & (F.col("fill") < capacity)).select("group", "bin")
        opened = scratch.save(opened, "opened")
        done = done.unionByName(packed.join(opened, ["group", "bin"], "left_anti").select("uid", key))
        groups = -(-groups // FAN_IN)
        left = packed.join(opened, ["group", "bin"], "left_semi").select("uid", "length", F.floor(F.col("group") / FAN_IN).cast("long").alias("group"))
        level += 1
    return done.unionByName(packed.select("uid", key))


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            flat, at = encoder(tokenizer).encode(batch.column(1))
            rows: list[list] = [[], [], [], [], []]
            for i, doc in enumerate(batch.column(0).to_pylist()):
                start = 0
                for k, n in enumerate(cut(int(at[i + 1] - at[i]), capacity)):
                    ids = flat[at[i] + start : at[i] + start + n]
                    for column, x in zip(rows, (doc, k, start, n, ids_crc32(ids)), strict=True):
                        column.append(x)
                    start += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = docs.mapInArrow(_pieces(tokenizer, capacity), _PIECE).withColumn("uid", F.monotonically_increasing_id())
    pieces = scratch.save(pieces, "pieces")
    placed = pieces.join(pack(pieces, capacity, scratch, **options), "uid")
    order = Window.partitionBy("sequence_id").orderBy("uid")
    offset = F.sum("length").over(order) - F.col("length")
    return placed.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", offset.alias("offset"))
