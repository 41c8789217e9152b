"""A table from pieces of text to their ids that encodes each distinct piece once."""

from __future__ import annotations

import numpy as np
import pandas as pd

from . import textkernels as K


class WordTable:
    """Pieces are known by 64-bit hashes.  The table holds at most `most` pieces and starts anew when it is full."""

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def encode_new(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces that aren't known yet; none is empty."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.young = np.zeros(0, np.uint64)  # sorted, not merged yet
        self.young_slot = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.full = 0  # of self.ids

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for those not known."""
        out = np.full(len(keys), -1, np.int64)
        for have, slot in ((self.known, self.slot), (self.young, self.young_slot)):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = slot[at[hit]]
        return out

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        """`keys` is sorted and holds no known key."""
        got = self.encode_new(texts)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(lengths.sum()))
        if self.full + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.full], np.zeros(max(len(flat), self.full // 2), np.uint32)))
        self.ids[self.full : self.full + len(flat)] = flat
        slots = len(self.lengths) + np.arange(len(keys))
        self.starts = np.concatenate((self.starts, self.full + np.concatenate(([0], np.cumsum(lengths)[:-1]))))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.full += len(flat)
        young, slot = np.concatenate((self.young, keys)), np.concatenate((self.young_slot, slots))
        order = np.argsort(young, kind="stable")
        self.young, self.young_slot = young[order], slot[order]
        if len(self.young) > 20_000 + len(self.known) // 4:
            known, slot = np.concatenate((self.known, self.young)), np.concatenate((self.slot, self.young_slot))
            order = np.argsort(known, kind="stable")
            self.known, self.slot = known[order], slot[order]
            self.young, self.young_slot = self.young[:0], self.young_slot[:0]

    def lookup(self, raw: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and n+1 offsets, for texts (offsets `at` in `raw`) cut into pieces at `start`."""
        stop = np.concatenate((start[1:], [len(raw)])) if len(start) else start
        of, keys = pd.factorize(K.span_hashes(raw, start, stop))
        where = np.zeros(len(keys), np.int64)
        where[of[::-1]] = np.arange(len(of))[::-1]
        if len(self.lengths) + len(keys) > self.most:
            self._clear()
        slots = self._find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            new = new[np.argsort(keys[new])]
            data = raw.tobytes()
            spans = zip(start[where[new]].tolist(), stop[where[new]].tolist(), strict=True)
            self._add(keys[new], [data[a:b].decode("utf-8", "replace") for a, b in spans])
            slots = self._find(keys)
        slot = slots[of]
        lengths = self.lengths[slot] if len(slot) else np.zeros(0, np.int64)
        sums = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.ids[np.repeat(self.starts[slot] - sums[:-1], lengths) + np.arange(sums[-1])] if len(slot) else np.zeros(0, np.uint32)
        return flat, sums[np.searchsorted(start, at)]
