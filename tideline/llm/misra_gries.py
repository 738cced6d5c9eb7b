"""Misra-Gries summaries of counted keys, held as sorted arrays.

A summary keeps at most ``capacity`` counters. When more keys are met, the
(capacity + 1)-th largest count is taken off every counter and those that reach
zero go; each time, that takes away at least capacity + 1 times as much mass as
it adds to ``lost``. So over a mass of m, ``lost`` stays at most
m / (capacity + 1), a key's count is at least its counter and at most its
counter plus ``lost``, and a key that is more frequent than that bound always
survives. Summaries of parts merge into one with the same bound.
"""

from __future__ import annotations

import numpy as np

from tideline.llm.words import run_starts


class Summary:
    """Counters of unsigned 32-bit keys."""

    def __init__(self, capacity: int):
        self.capacity = max(1, int(capacity))
        self.keys = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.int64)
        self.lost = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Another part's distinct keys and their counts."""
        self._waiting.append((keys, counts))
        self._held += len(keys)
        # Sorting as many keys again as there are counters keeps the cost of a key constant.
        if self._held > max(self.capacity, 1 << 16):
            self.settle()

    def merge(self, other: Summary) -> None:
        """Take over another summary of the same capacity."""
        other.settle()
        self.add(other.keys, other.counts)
        self.lost += other.lost
        self.settle()

    def settle(self) -> None:
        """Add up what waits, and fall back to the capacity."""
        if self._waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self._waiting)])
            counts = np.concatenate([self.counts, *(c for _, c in self._waiting)]).astype(np.int64)
            self._waiting, self._held = [], 0
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = run_starts(keys)
            self.keys = keys[first]
            self.counts = np.add.reduceat(counts, first) if len(first) else counts
        extra = len(self.counts) - self.capacity
        if extra > 0:
            # The (capacity + 1)-th largest is the extra-th smallest.
            off = int(np.partition(self.counts, extra - 1)[extra - 1])
            self.lost += off
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def survivors(self, threshold: int) -> np.ndarray:
        """Ascending keys whose count may reach the threshold; none that does is missing."""
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]
