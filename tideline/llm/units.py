"""Ids of distinct units, kept by a worker between tasks and packs.

A unit is a byte range that a tokenizer encodes the same wherever it stands.
Units are looked up by a 64-bit hash, and then their bytes are compared with
those the hash was learnt from, so ids never rest on a hash alone.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np

from tideline.llm.words import Hasher

#: Units that are remembered, where nothing else is said, before the worker starts again.
KEPT = 300_000

#: Ids of units given as bytes: all ids in one array, and the number of each.
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def worker_cache() -> dict:
    """A dict that lives as long as the worker's process.

    This package travels to the workers by value, so its own globals are new in
    every task.
    """
    name = "_tideline_worker"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class UnitCache:
    """Ids by unit."""

    def __init__(self, encode: Encode, hasher: Hasher | None = None, kept: int = KEPT):
        self.encode, self.hasher, self.kept = encode, hasher or Hasher(8), kept
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids, self.id_start = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.text, self.text_start = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _learn(self, raw: bytes, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Encode the units and keep them; their numbers."""
        ids, size = self.encode([raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        number = len(self.id_start) - 1 + np.arange(len(first))
        self.ids = np.concatenate([self.ids, ids])
        self.id_start = np.concatenate([self.id_start, self.id_start[-1] + np.cumsum(size)])
        self.text = np.concatenate([self.text, data[gather(first, last - first)]])
        self.text_start = np.concatenate([self.text_start, self.text_start[-1] + np.cumsum(last - first)])
        return number

    def _differs(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Units whose bytes are not those of the known unit."""
        start = self.text_start[unit]
        wrong = self.text_start[unit + 1] - start != size
        rest = np.flatnonzero(~wrong & (size > 0))
        if len(rest):
            n = size[rest]
            other = data[gather(first[rest], n)] != self.text[gather(start[rest], n)]
            wrong[rest] = np.logical_or.reduceat(other, np.cumsum(n) - n)
        return np.flatnonzero(wrong)

    def __call__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and the number of each unit."""
        if len(self.known) > self.kept:
            self._forget()
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        hashes = self.hasher.strings(data, first, last)
        unique, sample, index = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.searchsorted(self.known, unique)
        fresh = np.ones(len(unique), np.bool_)
        if len(self.known):
            fresh = self.known[np.minimum(found, len(self.known) - 1)] != unique
        raw = data.tobytes() if fresh.any() else b""
        if fresh.any():
            number = self._learn(raw, data, first[sample[fresh]], last[sample[fresh]])
            self.known = np.insert(self.known, found[fresh], unique[fresh])
            self.place = np.insert(self.place, found[fresh], number)
            # Each place moves on by the fresh units before it.
            found = found + np.cumsum(fresh) - fresh
        unit = self.place[found][index]
        wrong = self._differs(data, first, last - first, unit)
        if len(wrong):
            unit[wrong] = self._learn(raw or data.tobytes(), data, first[wrong], last[wrong])
        size = self.id_start[unit + 1] - self.id_start[unit]
        return self.ids[gather(self.id_start[unit], size)], size
