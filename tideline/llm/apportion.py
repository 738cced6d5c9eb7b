"""Highest-quotient (Sainte-Laguë) apportionment of whole seats."""

from __future__ import annotations

import heapq

import numpy as np


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1); ties go to the first.

    Starts from the rounding that a common divisor gives and corrects it seat
    by seat, so the work follows the number of weights, not of seats.
    """
    weights = np.asarray(weights, np.float64)
    given = np.zeros(len(weights), np.int64)
    total = weights.sum()
    if seats <= 0 or total <= 0:
        return given
    given = np.floor(weights / (total / seats) + 0.5).astype(np.int64)
    gap = seats - int(given.sum())
    if gap > 0:
        heap = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, given, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(gap):
            i = heap[0][1]
            given[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * given[i] + 1), i))
    elif gap < 0:
        heap = [(w / (2 * g - 1), -i) for i, (w, g) in enumerate(zip(weights, given, strict=True)) if g > 0]
        heapq.heapify(heap)
        for _ in range(-gap):
            i = -heap[0][1]
            given[i] -= 1
            if given[i] > 0:
                heapq.heapreplace(heap, (weights[i] / (2 * given[i] - 1), -i))
            else:
                heapq.heappop(heap)
    return given
