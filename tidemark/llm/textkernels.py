"""Vectorised text kernels over Arrow string columns.

A batch's texts are taken as one byte buffer.  Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``;
a word's identity is a 64-bit hash from prefix sums of a polynomial modulo 2**64 with an odd base (so that a
prefix's power can be divided out), followed by a bijective mixer.  With n distinct words the chance of any
collision is about n*n/2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that a kernel handles at once.  A longer single text is handled alone.
CHUNK = 2 << 20


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if len(have) <= 2 * CHUNK:  # what a very long text needs isn't kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    if not len(start):
        return np.zeros(0, U64)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTES[raw] * _power(_BASE, len(raw)), dtype=U64, out=sums[1:])
    value = (sums[end] - sums[start]) * _power(_INVERSE, len(raw))[start]
    return mix(value + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and n+1 offsets of the texts in that list of words."""
    n = len(raw)
    inside = ~_SPACE[raw]
    inner = at[(at > 0) & (at < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[inner] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[inner - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts after lower-casing A-Z, and n+1 offsets of the texts among them."""
    raw, at = buffers(column)
    raw = _LOWER[raw]
    start, end, first = word_spans(raw, at)
    return span_hashes(raw, start, end), first


def text_index(first: np.ndarray) -> np.ndarray:
    """For each element, the number of the text it belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def word_hash(word: str) -> int:
    """The hash that :func:`words` gives one word."""
    return int(words(pa.array([word]))[0][0])
