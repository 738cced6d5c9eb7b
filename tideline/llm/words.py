"""Words, windows and their hashes over a run of documents held as one byte array.

Inside a task, documents are taken in packs of about one megabyte: the bytes
of their texts lie in one array, so words are found and hashed by a few array
operations for all of them. A word is a maximal run of bytes of a class; both
classes used here hold every byte above 0x7F, so UTF-8 letters stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PACK_BYTES = 1 << 20

_SPACES = [0x20, *range(0x09, 0x0E)]


def visible_bytes() -> np.ndarray:
    """Class of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, np.bool_)
    table[_SPACES] = False
    return table


def letter_bytes() -> np.ndarray:
    """Class of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: 0-9, a-z and all above 0x7F."""
    table = np.zeros(256, np.bool_)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z, every other byte stays."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def packs(offsets: np.ndarray, limit: int = PACK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of some documents: byte ranges, and the first word of each document."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its document."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of member bytes; a run never crosses the start of a document."""
    inside = member[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    starts = np.ones(len(values), np.bool_)
    starts[1:] = values[1:] != values[:-1]
    return np.flatnonzero(starts)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; one-to-one."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Longest string, in bytes, that is hashed by a polynomial.
SHORT = 16


class Hasher:
    """64-bit hashes of words and of windows of words.

    Bytes go through a table of random 64-bit values, sums over a range come
    from one running sum, and dividing by a power of the odd base makes them
    free of the place. Two hashers with different seeds are independent.

    Modulo 2^64 a polynomial is sound for short strings only: there are pairs
    of 1,024 letters that agree under every base. Words of more than ``SHORT``
    bytes are therefore hashed by keyed BLAKE2b. Windows are sums over mixed
    hashes of at most a few dozen words, and of distinct ascending values in
    the case of sets.
    """

    def __init__(self, seed: int = 1):
        self.secret = seed.to_bytes(8, "little")
        draw = np.random.default_rng(seed)
        self.letters = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(1 << 40, 1 << 62)) * 8 + 5 & (1 << 64) - 1
        self.power = _powers(self.base, 1)
        self.inverse = self.power

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            self.power = _powers(self.base, n)
            self.inverse = _powers(pow(self.base, -1, 1 << 64), n)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=total[1:])
        return total

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        total = self._sums(self.letters[data])
        return mix((total[end] - total[start]) * self.inverse[start])

    def strings(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range, sound for any length."""
        out = self.ranges(data, start, end)
        long = np.flatnonzero(end - start > SHORT)
        if len(long):
            view = memoryview(np.ascontiguousarray(data))
            digests = [
                hashlib.blake2b(view[a:b], digest_size=8, key=self.secret).digest()
                for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)
            ]
            out[long] = np.frombuffer(b"".join(digests), np.uint64)
        return out

    def words(self, data: np.ndarray, words: Words) -> np.ndarray:
        return self.strings(data, words.start, words.end)

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of ``size`` consecutive values from each place that has so many."""
        if len(hashes) < size:
            return np.zeros(0, np.uint64)
        total = self._sums(hashes)
        n = len(hashes) - size + 1
        return mix((total[size:] - total[:n]) * self.inverse[:n] + np.uint64(size))

    def spans(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each range of values, of whatever length."""
        total = self._sums(hashes)
        size = (end - start).astype(np.uint64)
        return mix((total[end] - total[start]) * self.inverse[start] + size)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, hasher: Hasher, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ascending, and where each set starts.

    A document of fewer words than ``size`` has its whole word sequence as its
    one shingle; one without words has none.
    """
    words = find_words(data, offsets, visible_bytes())
    hashes = hasher.words(data, words)
    count = words.counts
    short = np.flatnonzero((count > 0) & (count < size))
    whole = hasher.windows(hashes, size)
    fits = words.room()[: len(whole)] >= size
    values = np.concatenate([whole[fits], hasher.spans(hashes, words.first[short], words.first[short + 1])])
    owner = np.concatenate([words.document()[: len(whole)][fits], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), np.bool_)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(offsets)))
