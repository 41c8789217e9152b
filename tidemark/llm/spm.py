"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is normalised as the model says (identity here: a space before it, spaces as U+2581) and cut into marked
words, a run of marks with what follows.  No piece of the vocabulary reaches over such a cut, so words are encoded
alone.  The distinct words of a batch are sorted, which lays them out as a trie in depth-first order: each word
keeps the forward states of the prefix that it shares with the one before and extends them by its own rest.

A forward state at a position has the best way to reach it.  In a unigram model that is the largest sum of piece
scores.  In a merge (BPE) model a position is reached in exactly one way, by the merges of its prefix: the last
piece there is the one whose neighbour, the last piece where it starts, stays apart from it when the two are merged
alone.  Pieces that merging their own characters doesn't give are not in the lattice.  So one traversal serves both
models, and merge models give the library's ids.

Characters without a piece become byte pieces (or the unknown id).  Words' ids are kept in a table of bounded size
as long as a Python worker lives.  Decoding joins pieces, bytes as UTF-8, marks to spaces, and drops the leading
space.

Null texts are empty; empty texts have no ids.  Repeated rows are encoded each.  Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .scratch import bound_batches
from .wordtable import WordTable

MARK = "▁"
#: Words kept in a worker's table; when it is full it starts anew.
CACHE = 1_200_000
# Fixed values of the public model format: piece types, model types, and the cost of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str, model_type: int | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.model_type = model_type or model.trainer_spec.model_type
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models")
        if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("only models without user-defined and unused pieces")
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation that keep all spaces")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over a word's start")
        self.tails = {p[n:] for p in self.ids for n in range(len(p))}  # what a piece can end with
        self._stable: dict[str, bool] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces that merging gives; single characters where there is none."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                got = self.ids.get(parts[k] + parts[k + 1])
                if got is not None and (best is None or self.scores[got] > best):
                    best, at = self.scores[got], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, piece: str) -> bool:
        """Merging the piece's characters gives the piece."""
        got = self._stable.get(piece)
        if got is None:
            got = self._stable[piece] = self.merge(piece) == [piece]
        return got

    def apart(self, a: int, b: int) -> bool:
        """Merging the characters of two pieces gives just the two."""
        got = self._apart.get((a, b))
        if got is None:
            x, y = self.pieces[a], self.pieces[b]
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            got = self._apart[a, b] = self.merge(x + y) == [x, y]
        return got


class PrefixViterbi:
    """Forward states over words in sorted order.

    ``back[i]`` is (start, piece id or -1 for a character without piece) of the last piece at position i, ``score``
    its best sum; None where nothing ends.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.word = ""
        self.back: list[tuple[int, int] | None] = [(0, -2)]
        self.score = [0.0]

    def _extend(self, word: str, shared: int) -> None:
        del self.back[shared + 1 :], self.score[shared + 1 :]
        v = self.v
        merging = v.model_type == BPE
        for end in range(shared + 1, len(word) + 1):
            best: tuple[int, int] | None = None
            best_score = -float("inf")
            for start in range(end - 1, max(0, end - v.longest) - 1, -1):
                piece = word[start:end]
                if start < end - 1 and piece not in v.tails:
                    break
                before = self.back[start]
                if before is None:
                    continue
                i = v.ids.get(piece)
                if i is None:
                    if end - start > 1:
                        continue
                    i, gain = -1, v.unknown_score
                else:
                    gain = v.scores[i]
                if merging:
                    if i >= 0 and (not v.stable(piece) or before[1] >= 0 and not v.apart(before[1], i)):
                        continue
                    best = (start, i)
                    break
                if self.score[start] + gain > best_score:
                    best, best_score = (start, i), self.score[start] + gain
            self.back.append(best)
            self.score.append(best_score if best is not None else -float("inf"))
        self.word = word

    def ids(self, word: str) -> list[int]:
        """Ids of a word; words should come in sorted order."""
        shared, most = 0, min(len(word), len(self.word))
        if word.startswith(self.word):
            shared = len(self.word)
        else:
            while shared < most and word[shared] == self.word[shared]:
                shared += 1
        self._extend(word, shared)
        out: list[int] = []
        end = len(word)
        while end:
            start, i = self.back[end]
            if i >= 0:
                out.append(i)
            elif self.v.bytes:
                out += [self.v.bytes[b] for b in reversed(word[start:end].encode())]
            elif not (out and out[-1] == self.v.unknown):  # neighbours are one unknown piece
                out.append(self.v.unknown)
            end = start
        return out[::-1]


class Codec(WordTable):
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, model_type: int | None = None):
        super().__init__(CACHE)
        self.v = Vocabulary(path, model_type)
        self.viterbi = PrefixViterbi(self.v)
        spelled = []
        for i, piece in enumerate(self.v.pieces):
            if i in self.v.byte_of:
                spelled.append(bytes([self.v.byte_of[i]]))
            elif i == self.v.unknown:
                spelled.append(" ⁇ ".encode())
            else:
                spelled.append(b"" if i in self.v.controls else piece.replace(MARK, " ").encode())
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(x) for x in spelled])))

    def encode_new(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        self.viterbi.reset()
        for word, i in sorted((t.replace(" ", MARK), i) for i, t in enumerate(texts)):
            out[i] = self.viterbi.ids(word)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column and n+1 offsets."""
        raw, at = K.buffers(column)
        if self.v.prefix:  # a space before every text that isn't empty
            some = np.diff(at) > 0
            shift = np.concatenate(([0], np.cumsum(some)))
            out = np.full(len(raw) + shift[-1], 32, np.uint8)
            out[np.arange(len(raw)) + np.repeat(shift[1:], np.diff(at))] = raw
            raw, at = out, at + shift
        start = np.zeros(len(raw) + 1, bool)
        start[1:-1] = (raw[1:] == 32) & (raw[:-1] != 32)
        written = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) + 3  # a mark in the text
        start[written] = False
        start[at] = True
        return self.lookup(raw, at, np.flatnonzero(start[:-1]))

    def decode(self, flat: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts and n+1 offsets."""
        size = np.diff(self.spelled_at)[flat]
        sums = np.concatenate(([0], np.cumsum(size)))
        data = self.spelled[np.repeat(self.spelled_at[flat] - sums[:-1], size) + np.arange(sums[-1])]
        ends = sums[at]
        if not self.v.prefix:
            return data.tobytes(), ends
        keep = np.ones(len(data), bool)
        some = ends[:-1][np.diff(ends) > 0]
        keep[some[data[some] == 32]] = False
        return data[keep].tobytes(), np.concatenate(([0], np.cumsum(keep)))[ends]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a model file and worker."""
    return Codec(path)


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*codec(path).encode(batch.column(1)))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = part.column(1).fill_null([])
                at = ids.offsets.to_numpy().astype(np.int64)
                data, ends = codec(path).decode(ids.values.to_numpy()[at[0] : at[-1]], at - at[0])
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            flat, at = codec(path).encode(batch.column(1))
            data, ends = codec(path).decode(flat, at)
            raw, whole = K.buffers(batch.column(1))
            text = raw.tobytes()
            wide, n = flat.astype("<u4"), range(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at)),
                    pa.array([zlib.crc32(wide[at[i] : at[i + 1]].tobytes()) for i in n], pa.int64()),
                    pa.array([data[ends[i] : ends[i + 1]] == text[whole[i] : whole[i + 1]] for i in n], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "round_trip"],
            )

    return run


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row."""
    return _input(docs, id_col, text_col).mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row; null ids give an empty text."""
    rows = tokens.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model), "doc_id long, text string")


def token_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (decoding gives the text)."""
    return _input(docs, id_col, text_col).mapInArrow(_digest(model), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
