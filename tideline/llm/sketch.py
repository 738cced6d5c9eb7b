"""A count-min sketch that saturates at two, over packs, merged slice by slice.

Each of two hash functions has two bit planes over its cells, "seen" and "seen
again". A key whose cells are not all "seen again" occurs once for certain:
counts are overestimated and no repeated key is lost. The size of the planes
is fixed by the caller; when they fill up, more keys are estimated repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tideline.llm.packs import unpack

_SLICES = 64
Keys = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _cells(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch."""
    other = key * np.uint64(0x9E3779B97F4A7C15)
    return [(key >> np.uint64(64 - bits)).astype(np.int64), ((other ^ (other >> np.uint64(29))) >> np.uint64(64 - bits)).astype(np.int64)]


def _get(plane: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (plane[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _set(plane: np.ndarray, cell: np.ndarray) -> None:
    """Set the bits of ascending, distinct cells."""
    if len(cell):
        byte = cell >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        plane[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (cell & 7).astype(np.uint8)), first)


def _sketch(make_keys: Callable[[], Keys], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = make_keys()
        once = np.zeros((2, 1 << bits - 3), np.uint8)
        again = np.zeros((2, 1 << bits - 3), np.uint8)
        for batch in batches:
            for _, _, data, offsets in unpack(batch):
                for row, cell in enumerate(_cells(keys(data, offsets), bits)):
                    cell.sort()
                    new = np.ones(len(cell), np.bool_)
                    new[1:] = cell[1:] != cell[:-1]
                    # Cells met twice here, or here and before.
                    twice = cell[~new]
                    cell = cell[new]
                    seen = _get(once[row], cell)
                    _set(again[row], cell[seen])
                    _set(again[row], np.unique(twice))
                    _set(once[row], cell[~seen])
        width = (1 << bits - 3) // _SLICES
        for row in range(2):
            for k in range(_SLICES):
                part = slice(k * width, (k + 1) * width)
                if once[row, part].any():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row * _SLICES + k], pa.int32()),
                            pa.array([zlib.compress(once[row, part].tobytes(), 1)], pa.binary()),
                            pa.array([zlib.compress(again[row, part].tobytes(), 1)], pa.binary()),
                        ],
                        names=["slice", "once", "again"],
                    )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Planes of sorted slices; only the "seen again" plane is needed afterwards."""
    now, once, again = None, None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([again.tobytes()], pa.binary())], names=["slice", "again"]
        )

    for batch in batches:
        for row in range(batch.num_rows):
            k = batch.column("slice")[row].as_py()
            a = np.frombuffer(zlib.decompress(batch.column("once")[row].as_py()), np.uint8)
            b = np.frombuffer(zlib.decompress(batch.column("again")[row].as_py()), np.uint8)
            if k != now:
                if now is not None:
                    yield done()
                now, once, again = k, a.copy(), b.copy()
            else:
                again |= b | (once & a)
                once |= a
    if now is not None:
        yield done()


def maybe_repeated(key: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Which keys the merged sketch estimates to occur twice or more."""
    maybe = np.ones(len(key), np.bool_)
    for row, cell in enumerate(_cells(key, bits)):
        maybe &= _get(planes[row], cell)
    return maybe


def seen_again(packs: DataFrame, make_keys: Callable[[], Keys], bits: int) -> Broadcast:
    """The merged "seen again" planes of the keys of all packs, 2^bits cells each."""
    slices = (
        packs.mapInArrow(_sketch(make_keys, bits), "slice int, once binary, again binary")
        .repartition(2 * _SLICES, "slice").sortWithinPartitions("slice")
        .mapInArrow(_merge, "slice int, again binary")
    )
    planes = np.zeros((2, 1 << bits - 3), np.uint8)
    width = (1 << bits - 3) // _SLICES
    for k, again in slices.toLocalIterator():  # 2^bits / 4 bytes in all
        row, part = divmod(k, _SLICES)
        planes[row, part * width : (part + 1) * width] = np.frombuffer(again, np.uint8)
    return packs.sparkSession.sparkContext.broadcast(planes)


def cell_bits(keys: int, max_cells: int) -> int:
    """Bits for about four cells a key, at most ``max_cells``."""
    return max(16, min(int(max_cells).bit_length() - 1, int(4 * keys + 1).bit_length()))
