"""Canonical length-limited Huffman codes over whole arrays of ids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_LENGTH = 20
CHECKPOINT = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Best code length of each symbol under the limit, 0 for symbols never seen.

    Package-merge: ``limit`` times, neighbours of the merged list are packed in
    pairs and merged with the symbols again. Only which places hold packages
    is kept of a level; walking back from the last one tells how many of the
    rarest symbols each level uses, and a symbol's length is the number of
    levels that use it.
    """
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no code of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, packed = leaves, [np.zeros(len(leaves), np.bool_)]
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        pairs = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        packed.append(place >= len(leaves))
    take = 2 * len(leaves) - 2
    uses = np.zeros(len(leaves) + 1, np.int64)
    for level in reversed(packed):
        packages = int(level[:take].sum())
        uses[take - packages] += 1
        take = 2 * packages
    # A level that uses the m rarest symbols adds one bit to each of them.
    lengths[order] = np.cumsum(uses[::-1])[::-1][1:]
    return lengths


@dataclass
class Codebook:
    """Codes that follow from the lengths alone: by length, then by id."""

    lengths: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        self.order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[self.order].astype(np.int64)
        self.bits = int(size[-1]) if len(size) else 1
        room = np.left_shift(1, self.bits - size)
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[self.order] = ((np.cumsum(room) - room) >> (self.bits - size)).astype(np.uint64)
        self._room = room

    def decoding_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and code length for each value of the next ``bits`` bits."""
        symbol = np.repeat(self.order, self._room).astype(np.uint32)
        pad = (1 << self.bits) - len(symbol)
        symbol = np.concatenate([symbol, np.full(pad, self.order[0] if len(self.order) else 0, np.uint32)])
        return symbol, self.lengths[symbol].astype(np.int64)


def encode(ids: np.ndarray, book: Codebook) -> tuple[bytes, np.ndarray]:
    """Packed codes and the bit offset of every CHECKPOINT-th id."""
    size = book.lengths[ids]
    end = np.cumsum(size)
    at = end - size
    word = at >> 5
    value = book.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    out = np.zeros((int(end[-1]) >> 5) + 3 if len(ids) else 3, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::CHECKPOINT]


def decode(
    payload: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray], bits: int
) -> np.ndarray:
    """The ids: all runs between checkpoints are read side by side, one id a step."""
    symbol, size = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = checkpoints.astype(np.int64).copy()
    steps = min(CHECKPOINT, n)
    out = np.empty((steps, len(at)), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    last = len(pairs) - 1
    for k in range(steps):
        ahead = pairs[np.minimum(at >> 5, last)] >> (64 - bits - (at & 31)).astype(np.uint64)
        key = (ahead & mask).astype(np.int64)
        out[k] = symbol[key]
        at += size[key]
    return out.T.ravel()[:n] if len(at) > 1 else out[:n, 0] if len(at) else np.zeros(0, np.uint32)
