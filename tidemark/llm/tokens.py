"""Encoding of whole texts with a byte-level BPE of the `tokenizers` library, each distinct piece of text once.

A text is cut where the tokenizer's own pre-tokenisation is certain to cut (contractions, letters, digits, other
characters, each with one optional space before it; white space apart).  The library encodes every distinct piece,
and a text's ids are those of its pieces in order, which equals encoding the text whole.  Cuts are made only
between ASCII characters or around single ASCII white space; elsewhere a piece just is longer:

- before a space that follows or precedes an ASCII character other than white space;
- before other white space that follows such a character, and after it if it stands alone;
- between an ASCII letter or digit and ASCII punctuation, in either order, but not after an apostrophe.

Pieces are known by 64-bit hashes and kept in a bounded table as long as the Python worker lives.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa

from . import textkernels as K
from .wordtable import WordTable

#: Pieces kept in a worker's table; when it is full it starts anew.
CACHE = 1_200_000
#: The id that ends every document.
END = 2

_CLASS = np.zeros(256, np.uint8)  # 0: anything else
_CLASS[32] = 1
_CLASS[9:14] = 2
_CLASS[[c for c in range(33, 127)]] = 4
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3
_CLASS[39] = 5
_SOLID = np.array([0, 0, 0, 1, 1, 1], bool)


def piece_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in `raw` at which pieces start; `at` has the n+1 offsets of the texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[raw]
    first = np.zeros(n + 1, bool)
    first[at] = True  # where a text starts, or the one before ended

    def shifted(by: int) -> np.ndarray:
        """The classes `by` places on (back if negative); 0 outside the text."""
        out = np.zeros(n, np.uint8)
        if by > 0:
            out[:-1] = kind[1:]
            out[first[1:]] = 0
        else:
            out[-by:] = kind[:by]
            for k in range(-by):
                out[k:][first[: n - k]] = 0
        return out

    back, back2, ahead = shifted(-1), shifted(-2), shifted(1)
    solid, solid_back = _SOLID[kind], _SOLID[back]
    start = first[:n] | (kind == 1) & (solid_back | _SOLID[ahead]) | (kind == 2) & solid_back
    start |= solid & (back == 2) & _SOLID[back2]
    start |= (back == 3) & (kind >= 4) | (back == 4) & (kind == 3)
    return np.flatnonzero(start)


class Encoder(WordTable):
    """Ids of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(CACHE)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # byte-level models spell bytes that aren't printable with the code points from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        odd = [b for b in range(256) if b not in printable]
        self.spelling = {b: 256 + k for k, b in enumerate(odd)}

    def encode_new(self, texts: list[str]) -> list[list[int]]:
        model = self.tokenizer.model
        space = chr(self.spelling[32])
        got: list[list[int]] = []
        rest = []
        for i, text in enumerate(texts):
            if (text[1:] if text[0] == " " else text).isalpha():  # the pre-tokeniser leaves it whole
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(self.spelling)
                elif text[0] == " ":
                    text = space + text[1:]
                got.append([t.id for t in model.tokenize(text)])
            else:
                got.append([])
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            got[i] = x.ids
        return got

    def encode(self, column: pa.Array, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, with `end` after each, and n+1 offsets."""
        raw, at = K.buffers(column)
        flat, offsets = self.lookup(raw, at, piece_starts(raw, at))
        if end is None:
            return flat, offsets
        out = np.full(len(flat) + len(column), end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(column)), np.diff(offsets))] = flat
        return out, offsets + np.arange(len(offsets))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a tokenizer file and worker."""
    return Encoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
