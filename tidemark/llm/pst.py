"""Language-model scores from a probabilistic suffix tree over words.

Tokens are the words of a text after lower-casing A-Z, then one end token; an end also stands before a text.  Every
word is a symbol.  A context of up to `depth` symbols is a candidate if it precedes at least `least` training tokens,
and lists next symbols that follow it at least twice.  A candidate is retained as a state if its next-symbol
distribution diverges from that of its longest retained proper suffix by more than a description of its symbols
costs.  A state's distribution is smoothed with its suffix's, and what it doesn't list falls back to the suffix with
the mass that is left, so every state's distribution sums to one.  The root gives a word its smoothed share of all
training tokens.  A text's score is the sum over its tokens of log10 of the probability in the longest retained
suffix of what precedes.

Texts are turned once into blocks: the distinct words of about `BLOCK` bytes of text, and each text as numbers into
that list, in a file of its own.  Words and the tree are partitioned by hash, and blocks and partitions exchange packed
messages.  In the first round a block sends its distinct words and hears their counts and numbers.  Then the tree grows in one round
a level: every block sends its distinct contexts of that length, and pairs of context and next symbol with the pair's
probability in the context's suffix, to the contexts' partitions; these test the contexts and reply with what changes.
Pairs and contexts whose shorter ones are too rare already aren't sent.  A pair that occurs often is a context of the
next round; its partition numbers it, so contexts are known by dense numbers, which take few bytes when sorted.  A block
keeps what it heard in a file a round.
Probabilities are exchanged in single precision, to which a state's distribution sums to one.  So what is gathered grows with the corpus
and no table of words or contexts is ever collected, broadcast or held in one task.

Base score: sum over tokens of ``log10((c + 1) / (N + V + 1))``.  Null and empty texts have the end token alone.  A
text with a null id takes the id's crc32 as that of an empty string.  Repeated rows count and are scored each.
Without training texts every score is 0.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .files import AtomicOutput, open_input
from .scratch import Scratch

U64 = np.uint64
#: Bytes of text in a block.
BLOCK = 10 << 20
#: Pseudo-counts of a state's suffix distribution.
PRIOR = 20.0
#: Training tokens for each partition of the tree.
PART_TOKENS = 2 << 20
#: In a reply: marks of contexts (1: a state, 2: a state whose listed symbols the block all has after it), the factors for
#: the suffix of the former states, training tokens of both, marks of pairs (1: occurs often, 2: listed), the listed ones'
#: counts; before another level, ranks of the pairs that occur often, and the partition that ranked them.
_REPLY = (np.uint8, np.float32, np.int64, np.uint8, np.int64, np.int64, np.int64)
_BLOCK_KIND = "block long, path string, texts long, tokens long"
_SENT_KIND = "block long, target long, data binary"
_REPLY_KIND = "round int, block long, target long, data binary, fresh long"


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**24 in byte planes."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, -1).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def _write(path: str, data: bytes) -> None:
    """Write a file; a task that runs again writes the same."""
    out = AtomicOutput(path)
    try:
        out.write(data)
    except BaseException:
        out.abandon()
        raise
    out.commit()


def _read(path: str) -> bytes:
    with open_input(path) as stream:
        return stream.read()


def _words_path(path: str) -> str:
    """The file of a block's words, which only the first round reads."""
    folder, name = path.rsplit("/", 1)
    return f"{folder}-words/{name}"


def _blocks(root: str):
    """Rows (id, held, text) as blocks: a file each and one of its words, the training texts and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held_rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held_rows, size, number
            ids, held, sizes, hashes = zip(*held_rows, strict=True)
            of, words = pd.factorize(np.concatenate(hashes))
            order = np.argsort(-np.bincount(of, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            sizes, held = np.concatenate(sizes), np.concatenate(held)
            path = f"{root}/block-{part:06d}-{number:06d}"
            hashes = words[order].view(U64)
            order = np.argsort(hashes)
            row = {"ids": [x for y in ids for x in y], "held": held, "sizes": sizes.astype(np.int64), "order": _pack_numbers(order), "seq": _pack_numbers(rank[of])}
            kinds = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("order", pa.binary()), ("seq", pa.binary())])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kinds, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(pa.RecordBatch.from_pylist([row], kinds))
            _write(_words_path(path), _pack(_steps(hashes[order])))
            _write(path, sink.getvalue().to_pybytes())
            texts = int((~held).sum())
            tokens = int(sizes[~held].sum()) + texts
            block, held_rows, size, number = part << 32 | number, [], 0, number + 1
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "path": [path], "texts": pa.array([texts], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

        for batch in K.chunks(batches, "text"):
            words, first = K.words(batch.column(2))
            held_rows.append((batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), np.diff(first), words))
            size += len(K.buffers(batch.column(2))[0])
            if size >= BLOCK or len(words) > BLOCK:
                yield flush()
        if held_rows:
            yield flush()

    return run


class Alphabet:
    """Of a tree in memory: symbol 0 is the end, 1 to K are words, K + 1 is any other word."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.size = len(words) + 2

    def symbols(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), self.size - 1, np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            out[hit] = at[hit] + 1
        return out


def _sequence(seq: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with a leading and a closing end, and where the texts start."""
    at = np.concatenate(([0], np.cumsum(sizes + 2)))
    out = np.zeros(at[-1], np.int64)
    out[np.arange(len(seq)) + 1 + 2 * np.repeat(np.arange(len(sizes)), sizes)] = symbols[seq]
    return out, at


def _contexts(s: np.ndarray, at: np.ndarray, depth: int, base: int) -> np.ndarray:
    """Code of the `depth` symbols before each position, -1 where the text has fewer; positions 1.. of each text."""
    place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
    code = np.zeros(len(s), np.int64)
    for k in range(1, depth + 1):
        code[k:] += s[:-k] * base ** (k - 1)
    code[place < depth] = -1
    return code


class SuffixTree:
    """Retained states with smoothed next-symbol distributions; state 0 is the root.

    The tree in memory, for small alphabets; `_grow` decides alike for a partition of the contexts.
    """

    def __init__(self, alphabet: Alphabet, root: np.ndarray):
        self.alphabet = alphabet
        self.root = root  # probabilities of the symbols
        self.parent = [0]
        self.back = [1.0]  # mass left for the suffix, over what the suffix gives what isn't listed
        self.listed: list[dict[int, float]] = [{}]
        self.codes: list[dict[int, int]] = [{0: 0}]  # by length: code to state

    def probability(self, state: int, symbol: int) -> float:
        factor = 1.0
        while state:
            got = self.listed[state].get(symbol)
            if got is not None:
                return factor * got
            factor *= self.back[state]
            state = self.parent[state]
        return factor * self.root[symbol]

    def suffix(self, code: int, length: int) -> int:
        """The longest retained state that is a suffix of the context."""
        for k in range(min(length, len(self.codes) - 1), -1, -1):
            state = self.codes[k].get(code % self.alphabet.size**k)
            if state is not None:
                return state
        return 0

    def grow(self, length: int, code: int, total: int, counts: dict[int, int]) -> None:
        """Retain the context if it diverges enough from its longest retained proper suffix."""
        while len(self.codes) <= length:
            self.codes.append({})
        parent = self.suffix(code % self.alphabet.size ** (length - 1), length - 1)
        below = {x: float(np.float32(self.probability(parent, x))) for x in counts}
        kept = {x: n for x, n in counts.items() if n * abs(math.log(n / total / below[x])) > 0.5 * math.log(total + 1)}
        if not kept:
            return
        rest, rest_below = total - sum(kept.values()), 1 - sum(below[x] for x in kept)
        gain = sum(n * math.log(n / total / below[x]) for x, n in kept.items())
        if rest > 0 and rest_below > 0:
            gain += rest * math.log(rest / total / rest_below)
        if gain < 0.5 * (len(kept) + 1) * math.log(total + 1) or rest_below <= 0:
            return
        listed = {x: (n + PRIOR * below[x]) / (total + PRIOR) for x, n in kept.items()}
        left = 1 - sum(listed.values())
        self.codes[length][code] = len(self.parent)
        self.parent.append(parent)
        self.listed.append(listed)
        self.back.append(float(np.float32(max(left, 1e-12) / max(rest_below, 1e-12))))

    def freeze(self) -> FrozenTree:
        return FrozenTree(self)


class FrozenTree:
    """The tree as arrays, for whole sequences at a time."""

    def __init__(self, tree: SuffixTree):
        self.base = tree.alphabet.size
        self.parent = np.array(tree.parent)
        self.log_back = np.log10(np.array(tree.back))
        self.log_root = np.log10(tree.root)
        pairs = sorted((s * self.base + x, math.log10(p)) for s, listed in enumerate(tree.listed) for x, p in listed.items())
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.log_pair = np.array([v for _, v in pairs])
        self.levels = []
        for codes in tree.codes[1:]:
            order = np.array(sorted(codes), np.int64)
            self.levels.append((order, np.array([codes[c] for c in order.tolist()], np.int64)))

    def score(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each position's symbol; 0 at the leading ends."""
        state = np.zeros(len(s), np.int64)
        for k, (codes, states) in enumerate(self.levels, 1):
            if len(codes):
                code = _contexts(s, at, k, self.base)
                where = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[where] == code
                state[hit] = states[where[hit]]
        out = np.zeros(len(s))
        live = np.arange(len(s))
        while len(live):
            at_root = state[live] == 0
            out[live[at_root]] += self.log_root[s[live[at_root]]]
            live = live[~at_root]
            if not len(live):
                break
            key = state[live] * self.base + s[live]
            where = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[where] == key
            out[live[hit]] += self.log_pair[where[hit]]
            live = live[~hit]
            out[live] += self.log_back[state[live]]
            state[live] = self.parent[state[live]]
        out[at[:-1]] = 0
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each in byte planes."""
    out = [np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()]
    out += [np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays again, given the types that they had."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out, at = [], 8 * len(kinds) + 8
    for kind, n in zip(kinds, raw[8:at].view("<i8").tolist(), strict=True):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, -1).T).reshape(-1).view(kind))
        at += n * wide
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, whose high bytes are few."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def _numbered(partition: int, rank: np.ndarray, partitions: int) -> np.ndarray:
    """Distinct numbers for what partitions ranked each by themselves; 0 is left for the end."""
    return rank * partitions + partition + 1


#: Bits of a context's key below its partition.
_PLACE = 40


def _dealt(numbers: np.ndarray, partitions: int) -> np.ndarray:
    """Keys of contexts with these numbers: a partition, and a place that is distinct in it.  Neighbours in rank and
    contexts of one partition's last round are dealt to all partitions."""
    place, rest = np.divmod(numbers, partitions)
    return (place + rest) % partitions << _PLACE | place


def _runs(to: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal numbers: number, first place, end."""
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    return list(zip(to[starts].tolist(), starts.tolist(), np.append(starts, len(to))[1:].tolist(), strict=True))


def _targets(sorted_hashes: np.ndarray, partitions: int) -> list[tuple[int, int, int]]:
    """The partitions of hashes, in their order: number, first hash, end."""
    return _runs(((sorted_hashes >> U64(32)) * U64(partitions) >> U64(32)).astype(np.int64))


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of some numbers from 0 on, sorted, and each one's place among them.  Values are sorted together with
    their places where both fit, which is much faster than to sort places by values."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()) >> (63 - bits):
        return np.unique(x, return_inverse=True)
    both = np.sort(x << bits | np.arange(len(x)))
    value = both >> bits
    new = np.ones(len(x), bool)
    new[1:] = value[1:] != value[:-1]
    of = np.empty(len(x), np.int64)
    of[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return value[new], of


def _rises(x: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Numbers that rise within each group of `each` numbers, as a group's first and differences."""
    out = np.diff(x, prepend=x.dtype.type(0))
    starts = (np.cumsum(each) - each)[each > 0]
    out[starts] = x[starts]
    return out


def _risen(steps: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The numbers again."""
    sums = np.cumsum(steps)
    some = each[each > 0]
    starts = np.cumsum(some) - some
    return sums - np.repeat(sums[starts] - steps[starts], some)


class _Block:
    """A block, and the probabilities of its symbols in the tree as far as it has grown."""

    def __init__(self, path: str):
        self.path = path
        row = pa.ipc.open_stream(pa.py_buffer(_read(path))).read_all().combine_chunks()
        self.ids, self.held, self.sizes = (row.column(x).chunk(0).values.to_numpy(zero_copy_only=False) if x != "ids" else row.column(x).chunk(0).values for x in ("ids", "held", "sizes"))
        self.order = _unpack_numbers(row.column("order")[0].as_py()) + 1  # the words by hash
        self.symbols = len(self.order) + 1
        seq = _unpack_numbers(row.column("seq")[0].as_py())
        self.number, self.at = _sequence(seq, self.sizes, np.arange(1, self.symbols))
        width = self.sizes + 2
        self.place = np.arange(len(self.number)) - np.repeat(self.at[:-1], width)
        self.train = ~np.repeat(self.held, width)

    def _hashes(self) -> np.ndarray:
        return np.cumsum(_unpack(_read(_words_path(self.path)), U64)[0])

    def words(self, partitions: int) -> Iterator[tuple[int, bytes]]:
        """For each partition of the words: words and their counts in training texts."""
        counts = np.bincount(self.number[self.train], minlength=self.symbols)[self.order]
        hashes = self._hashes()
        for to, a, b in _targets(hashes, partitions):
            yield to, _pack(_steps(hashes[a:b]), counts[a:b])

    def count(self, replies: list[bytes], end: int, total: int, distinct: int, few: float, cut: tuple[int, int] | None) -> None:
        """The root, from all words' counts."""
        counts, self.global_ = np.full(self.symbols, end), np.zeros(self.symbols, np.int64)
        if replies:
            got = [_unpack(x, *[np.int64] * 3) for x in replies]
            counts[self.order] = np.concatenate([x for x, _, _ in got])
            self.global_[self.order] = np.concatenate([_numbered(of[0], rank, of[1]) for _, rank, of in got])
        order = np.argsort(self.global_)  # from here the block's own numbers rise with those of all blocks
        own = np.empty(len(order), np.int64)
        own[order] = np.arange(len(order))
        often = counts >= few
        if cut is not None:
            n, hashes = counts[self.order], self._hashes().view(np.int64)
            often[self.order] &= (n > cut[0]) | (n == cut[0]) & (hashes <= cut[1])
        self.number, self.global_, counts, often = own[self.number], self.global_[order], counts[order], often[order]
        self.counts = counts
        self.known = (counts > 0)[self.number]
        self.root = (counts + 1) / (total + distinct + 1)
        self.p = self.root[self.number]
        self.often = often[self.number]  # the symbol after the context of the last round, in all training texts
        self.called, self.names = self.number, self.global_  # of that context with the symbol, where it occurs often: the block's own number, and the numbers
        self.level = 0

    def deeper(self, partitions: int) -> None:
        """Go on to contexts with one more symbol: those of the last round, each with the symbol after it."""
        self.level += 1
        live = self.place >= self.level
        live[1:] &= self.often[:-1]  # how often the context itself occurs
        self.where = np.flatnonzero(live)
        own = self.called[self.where - 1]
        some = np.zeros(len(self.names), bool)
        some[own] = True
        some = np.flatnonzero(some)
        keys = _dealt(self.names[some], partitions)
        order = np.argsort(keys)
        self.contexts, rank = keys[order], np.empty(len(self.names), np.int64)
        rank[some[order]] = np.arange(len(order))
        self.of = rank[own]
        pairs = self.often[self.where]
        self.pair_where = self.where[pairs]
        self.pairs, self.pair_of = _unique(self.of[pairs] * self.symbols + self.number[self.pair_where])

    def _below(self) -> np.ndarray:
        """Probabilities of the pairs' symbols in the suffixes of their contexts."""
        below = np.empty(len(self.pairs), np.float32)
        below[self.pair_of] = self.p[self.pair_where]
        return below

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """For each of the tree's partitions: contexts, their training tokens and numbers of pairs; the distinct next
        symbols; the pairs' symbols as places among these, counts, and where these aren't 0 probabilities in the
        context's suffix; at the first level, where the suffix is the root, counts of the distinct symbols instead."""
        n = len(self.contexts)
        totals = np.bincount(self.of[self.train[self.where]], minlength=n)
        counts = np.bincount(self.pair_of[self.train[self.pair_where]], minlength=len(self.pairs))
        below = self._below()
        context, symbol = self.pairs // self.symbols, self.pairs % self.symbols
        each = np.bincount(context, minlength=n)
        firsts = np.concatenate(([0], np.cumsum(each)))
        for to, a, b in _runs(self.contexts >> _PLACE):
            x, y = firsts[a], firsts[b]
            own, of = _unique(symbol[x:y])
            listed, known = self.global_[own], self.counts[own if self.level == 1 else own[:0]]
            places = self.contexts[a:b] & ((1 << _PLACE) - 1)
            yield to, _pack(_steps(places), totals[a:b], each[a:b], _steps(listed), _rises(of, each[a:b]), counts[x:y], known, below[x:y][counts[x:y] > 0] if self.level > 1 else below[:0])

    def hear(self, replies: list[bytes], partitions: int) -> None:
        """Replies in the order of the partitions."""
        self.often = np.zeros(len(self.number), bool)
        if not replies:
            return
        got = [_unpack(x, *_REPLY) for x in replies]
        state, back, total, marks, count = (np.concatenate(x) for x in zip(*[x[:5] for x in got], strict=True))
        often, named = marks & 1 > 0, np.zeros(len(marks), np.int64)
        if len(got[0][6]):
            named[often] = np.concatenate([_numbered(int(x[6][0]), np.cumsum(x[5]), partitions) for x in got])
        below = self._below()
        of_context, totals = np.ones(len(self.contexts)), np.zeros(len(self.contexts), np.int64)
        totals[state > 0] = total
        own = marks & 2 > 0
        p = np.zeros(len(marks))
        context = self.pairs[own] // self.symbols
        p[own] = _smoothed(count, below[own], totals[context])
        sums = (np.bincount(context, x, len(totals)) for x in (p[own], below[own]))
        of_context[state == 2] = _left(*(x[state == 2] for x in sums))
        of_context[state == 1] = back
        self.p[self.where] *= of_context[self.of]
        self.often[self.pair_where] = often[self.pair_of]
        self.called, self.names = np.zeros(len(self.number), np.int64), named
        self.called[self.pair_where] = self.pair_of
        own = own[self.pair_of]
        self.p[self.pair_where[own]] = p[self.pair_of[own]]


def _count(partitions: int):
    """One partition of the words: every block's message to a reply of counts and numbers, small ones for frequent
    words; the first reply has how many distinct words are in training texts."""

    def run(sent: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py(), U64, np.int64) for x in sent.column("data")]
        words, counts = (np.concatenate(x) for x in zip(*[(np.cumsum(x), n) for x, n in got], strict=True))
        distinct, of = np.unique(words, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, of, counts)
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(distinct))
        place = np.array([sent.column("target")[0].as_py(), partitions])  # a word's number is rank * partitions + target + 1
        cuts = np.cumsum([len(x) for x, _ in got])[:-1]
        fresh = [int((total > 0).sum()), *[0] * (len(got) - 1)]
        data = [_pack(total[x], rank[x], place) for x in np.split(of, cuts)]
        return _replies(0, sent, data, fresh)

    return run


def _replies(level: int, sent: pa.Table, data: list[bytes], fresh: list[int]) -> pa.Table:
    return pa.table({"round": pa.array([level] * len(data), pa.int32()), "block": sent.column("block"), "target": sent.column("target"), "data": pa.array(data, pa.binary()), "fresh": pa.array(fresh, pa.int64())})


def _smoothed(count: np.ndarray, below: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probabilities of a state's listed symbols."""
    return (count + PRIOR * below.astype(np.float64)) / (total + PRIOR)


def _left(listed: np.ndarray, below: np.ndarray) -> np.ndarray:
    """States' factors for what they don't list, from sums of probabilities of what they do, in them and in their suffixes."""
    return (np.maximum(1 - listed, 1e-12) / np.maximum(1 - below, 1e-12)).astype(np.float32)


def _grow(level: int, last: bool, least: float, few: float, tokens: int):
    """One partition of the tree's contexts of a level: every block's message to a reply."""

    def run(sent: pa.Table) -> pa.Table:
        got = []
        for x in sent.column("data"):
            context, total, each, listed, at, count, known, below = _unpack(x.as_py(), *[np.int64] * 7, np.float32)
            at = _risen(at, each)
            if level == 1:
                below = ((known + 1) / tokens).astype(np.float32)[at]
            else:
                sent_, below = below, np.ones(len(count), np.float32)
                below[count > 0] = sent_
            got.append((np.cumsum(context), total, each, np.cumsum(listed)[at], count, below))
        context, total, each, symbol, count, below = (np.concatenate(x) for x in zip(*got, strict=True))
        contexts, of = _unique(context)
        n = len(contexts)
        totals = np.zeros(n, np.int64)
        np.add.at(totals, of, total)
        owner = np.repeat(of, each)
        symbols = int(symbol.max(initial=0)) + 1
        pairs, pair = _unique(owner * symbols + symbol)
        g, q = pairs // symbols, np.ones(len(pairs))
        q[pair[count > 0]] = below[count > 0]
        c = np.zeros(len(pairs), np.int64)
        np.add.at(c, pair, count)
        often = c >= few
        t = np.maximum(totals, 1)
        ratio = np.log(np.maximum(c, 1) / t[g] / q)
        keep = often & (totals[g] >= least) & (c * np.abs(ratio) > 0.5 * np.log(t[g] + 1))
        add = lambda x: np.bincount(g[keep], x[keep], minlength=n)
        kept, rest, rest_below, gain = np.bincount(g[keep], minlength=n), totals - add(c), 1 - add(q), add(c * ratio)
        both = (rest > 0) & (rest_below > 0)
        gain[both] += rest[both] * np.log(rest[both] / t[both] / rest_below[both])
        state = (kept > 0) & (gain >= 0.5 * (kept + 1) * np.log(t + 1)) & (rest_below > 0)
        listed = _smoothed(c, q, t[g])
        back = _left(add(listed), add(q))
        own = keep & state[g]
        marks = often + 2 * own.astype(np.uint8)
        rank, place = np.cumsum(often) - 1, sent.column("target")[0].as_py()
        none = np.empty(0, np.int64)
        replies, i, j = [], 0, 0
        for x in got:
            a, b = of[i : i + len(x[0])], pair[j : j + len(x[3])]
            states = a[state[a]]
            there = np.bincount(np.repeat(np.arange(len(a)), x[2])[own[b]], minlength=len(a)) == kept[a]
            mark = state[a] * (1 + there).astype(np.uint8)
            names = (none, none) if last else (_steps(rank[b[often[b]]]), np.array([place]))
            replies.append(_pack(mark, back[a[mark == 1]], t[states], marks[b], c[b[own[b]]], *names))
            i, j = i + len(a), j + len(b)
        return _replies(level, sent, replies, [0] * len(replies))

    return run


def _sent(block: int, messages: Iterator[tuple[int, bytes]]) -> pa.Table:
    rows = list(messages)
    return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "target": pa.array([t for t, _ in rows], pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})


def _ask(partitions: int):
    def run(row: dict) -> pa.Table:
        return _sent(row["block"], _Block(row["path"]).words(partitions))

    return run


def _hear(level: int):
    """Cogrouped by block: its path, and the replies of a round, which go to a file."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heard = [x for _, x in sorted(zip(*(right.column(x).to_pylist() for x in ("target", "data")), strict=True))] if right.num_rows else []
        _write(f"{left.column('path')[0].as_py()}.{level}", np.array([len(heard), *map(len, heard)], "<i8").tobytes() + b"".join(heard))
        return left.select(["block"])

    return run


def _recall(path: str) -> list[bytes]:
    data = _read(path)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = 8 * n + 8 + np.concatenate(([0], np.cumsum(np.frombuffer(data, "<i8", n, 8))))
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _each(run):
    """A function from a row of a block to a table, over batches; one block is held at a time."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from run(row).to_batches()

    return over


def _send(load, partitions: int):
    def run(row: dict) -> pa.Table:
        block = load(row)
        block.deeper(partitions)
        return _sent(row["block"], block.messages())

    return run


def _scores(load, total: int):
    def run(row: dict) -> pa.Table:
        block = load(row)
        inner = block.place > 0

        def sums(x: np.ndarray) -> np.ndarray:
            run_ = np.concatenate(([0], np.cumsum(np.where(inner, x, 0))))
            return run_[block.at[1:]] - run_[block.at[:-1]]

        n = len(block.sizes)
        return pa.table(
            {
                "doc_id": block.ids,
                "held_out": pa.array(block.held, pa.bool_()),
                "n_tokens": pa.array(block.sizes + 1),
                "n_known": pa.array(sums(block.known.astype(np.int64)).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, total, np.int64)),
                "base_score": pa.array(sums(np.log10(block.root)[block.number])),
                "score": pa.array(sums(np.log10(block.p))),
            }
        )

    return run


def _cut(blocks: DataFrame, alphabet: int) -> tuple[int, int]:
    """Count and hash of the last of the `alphabet` most frequent training words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for _, data in _Block(row["path"]).words(1):
                    steps, counts = _unpack(data, U64, np.int64)
                    yield pa.RecordBatch.from_pydict({"word": np.cumsum(steps).view(np.int64), "count": counts})

    top = blocks.mapInArrow(words, "word long, count long").filter("count > 0").groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word").limit(alphabet)
    last = top.orderBy("count", F.desc("word")).first()
    return (last["count"], last["word"]) if last else (1 << 62, 0)


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, alphabet: int | None = None, depth: int = 3, least: float = 2) -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are held out if crc32 of their id as text, modulo `folds`, is `fold`; the others train.  A `least` below 1 is
    a share of the training tokens, and a tenth of it that of listed next symbols.  With `alphabet`, only that many
    of the most frequent words are in contexts and listed.
    """
    scratch = Scratch(docs.sparkSession, "pst")
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.crc32(name) % folds == fold).alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = scratch.path("texts")
    blocks = scratch.save(rows.mapInArrow(_blocks(texts), _BLOCK_KIND), "blocks")
    own = blocks.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("texts", "tokens")], F.count("*").alias("blocks")).first()
    end, total = own["texts"], own["tokens"]
    partitions = total // PART_TOKENS + 1
    spread = blocks.select("block", "path").repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), own["blocks"]))
    counts = spread.mapInArrow(_each(_ask(partitions)), _SENT_KIND).groupBy("target").applyInArrow(_count(partitions), _REPLY_KIND)
    replies = scratch.save(counts, "counts")
    distinct = replies.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("n")).first()["n"]
    cut = None
    if alphabet is not None and alphabet < distinct:
        cut = _cut(blocks, alphabet)
    distinct += end > 0
    share = least * total if least < 1 else 0
    few, least = max(2, share / 10), max(2, share, least)

    def listen(replies: DataFrame, level: int) -> None:
        """Every block hears the replies of a round, which are dropped then."""
        scratch.save(blocks.select("block", "path").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_hear(level), "block long"), "heard")
        scratch.drop(replies)

    def load(level: int):
        """Of a block's row, the block with what it heard up to a level."""

        def run(row: dict) -> _Block:
            block = _Block(row["path"])
            for k in range(level + 1):
                heard = _recall(f"{row['path']}.{k}")
                if k:
                    block.deeper(partitions)
                    block.hear(heard, partitions)
                else:
                    block.count(heard, end, total, distinct, few, cut)
            return block

        return run

    if cut is None:
        scratch.drop(f"{texts}-words")
    listen(replies, 0)
    level = 0
    for level in range(1, depth + 1) if total else ():
        got = spread.mapInArrow(_each(_send(load(level - 1), partitions)), _SENT_KIND).groupBy("target").applyInArrow(_grow(level, level == depth, least, few, total + distinct + 1), _REPLY_KIND)
        listen(scratch.save(got, f"level{level}"), level)
    out = spread.mapInArrow(_each(_scores(load(level), total)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)
