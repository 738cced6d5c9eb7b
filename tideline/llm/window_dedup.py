"""Removal of words under repeated 35-word windows, behind a count-min prefilter.

First every partition sketches its windows: two bit planes over hash cells,
"seen" and "seen again", for each of two hash functions, a count-min sketch
that saturates at two. The partitions' planes are merged slice by slice. A
window whose cells are not all "seen again" is unique for certain, so the
sketch overestimates and loses none. In the second pass only windows
estimated repeated go, as packed 96-bit keys, to buckets of hash values, where
they are grouped exactly; a bit for each comes back to its pack. Last, packs
drop the words that repeated windows cover.

The merged sketch is at most ``max_cells`` / 8 bytes for each hash function
however large the corpus is; beyond that more windows are estimated repeated
and grouped, and the result is the same. A pack sends each of its windows
once, so a passage or a group of copies adds one key a pack, not one a copy.

Defined results: null or wordless text keeps nothing and loses nothing; texts
of fewer words than a window are kept whole. Two windows are the same if their
96-bit hashes are (for 10^13 windows, one wrong pair is expected in 1,000
runs). Repeated rows are documents of their own and remove each other. Only
doc_id and text of the input are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.packs import unpack, write_packs
from tideline.llm.sketch import cell_bits, maybe_repeated, seen_again
from tideline.llm.words import Hasher, Words, find_words, visible_bytes
from tideline.session import materialize

_SEED = 31


class _PackWindows:
    """Words of a pack and the hashes of its windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, hasher: Hasher):
        self.data, self.offsets = data, offsets
        self.words: Words = find_words(self.data, self.offsets, visible_bytes())
        hashes = hasher.words(self.data, self.words)
        self.size = size
        whole = hasher.windows(hashes, size)
        self.start = np.flatnonzero(self.words.room()[: len(whole)] >= size)
        self.key = whole[self.start]
        self._hashes = hashes

    def check(self, hasher: Hasher) -> np.ndarray:
        """A second, independent hash of the same windows."""
        return hasher.windows(self._hashes, self.size)[self.start]


def _window_keys(size: int):
    def make():
        hasher = Hasher(_SEED)
        return lambda data, offsets: _PackWindows(data, offsets, size, hasher).key

    return make


def _suspects(windows: _PackWindows, planes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows that may be repeated, by key; and which of them are the first of their key."""
    maybe = maybe_repeated(windows.key, planes, bits)
    place = np.flatnonzero(maybe)
    place = place[np.argsort(windows.key[place], kind="stable")]
    key = windows.key[place]
    first = np.ones(len(key), np.bool_)
    first[1:] = key[1:] != key[:-1]
    return place, first


def _bucket_edges(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts among ascending keys; buckets are equal ranges of the hash."""
    step = (1 << 64) // buckets
    return np.searchsorted(key, np.array([k * step for k in range(1, buckets)], np.uint64))


def _send(size: int, bits: int, buckets: int, planes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = Hasher(_SEED), Hasher(_SEED + 1)
        for batch in batches:
            for pack, _, data, offsets in unpack(batch):
                windows = _PackWindows(data, offsets, size, hasher)
                place, first = _suspects(windows, planes.value, bits)
                place = place[first]
                key = windows.key[place]
                check = windows.check(second)[place].astype(np.uint32)
                edges = np.concatenate([[0], _bucket_edges(key, buckets), [len(key)]])
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), pack, np.int64)),
                        pa.array([key[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()),
                        pa.array([check[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()),
                    ],
                    names=["bucket", "pack", "keys", "checks"],
                )

    return run


def _group(table: pa.Table) -> pa.Table:
    """For each key sent to a bucket, whether another pack sent it too."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    sizes = np.array([len(k) for k in keys])
    key = np.concatenate(keys)
    check = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("checks")])
    order = np.argsort(key, kind="stable")
    key, check = key[order], check[order]
    same = key[1:] == key[:-1]
    if (same & (check[1:] != check[:-1])).any():
        again = np.lexsort((check, key))
        order, key, check = order[again], key[again], check[again]
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
    repeated = np.zeros(len(key), np.bool_)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    answers = [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum(sizes)[:-1])]
    return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "repeated": pa.array(answers, pa.binary())})


def _remove(size: int, bits: int, buckets: int, planes):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        hasher = Hasher(_SEED)
        by_bucket = dict(zip(answers.column("bucket").to_pylist(), answers.column("repeated").to_pylist(), strict=True))
        out = []
        for _, ids, data, offsets in unpack(packs):
            windows = _PackWindows(data, offsets, size, hasher)
            words = windows.words
            place, first = _suspects(windows, planes.value, bits)
            key = windows.key[place[first]]
            edges = np.concatenate([[0], _bucket_edges(key, buckets), [len(key)]])
            elsewhere = np.zeros(len(key), np.bool_)
            for k, answer in by_bucket.items():
                n = edges[k + 1] - edges[k]
                elsewhere[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(answer, np.uint8), count=n)
            number = np.cumsum(first) - 1
            here = np.bincount(number, minlength=len(key)) > 1
            start = windows.start[place[(elsewhere | here)[number]]]
            n = len(words.start)
            change = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)[: n + 1]
            kept = np.cumsum(change[:n]) == 0
            out.append(_kept_rows(ids, windows, kept))
        return pa.concat_tables(out)

    return run


def _kept_rows(ids: pa.Array, windows: _PackWindows, kept: np.ndarray) -> pa.Table:
    """Each document's kept words joined by one blank."""
    words = windows.words
    owner = words.document()
    start, end, of = words.start[kept], words.end[kept], owner[kept]
    width = end - start + 1
    total = np.cumsum(width)
    source = np.repeat(start - (total - width), width) + np.arange(total[-1] if len(total) else 0)
    data = np.append(windows.data, np.uint8(0x20))[np.minimum(source, len(windows.data))]
    if len(total):
        data[total - 1] = 0x20
    docs = len(words.counts)
    bytes_of = np.bincount(of, weights=width, minlength=docs).astype(np.int64)
    left = np.bincount(of, minlength=docs)
    # The blank after a document's last word goes.
    drop = np.cumsum(bytes_of)[left > 0] - 1
    keep = np.ones(len(data), np.bool_)
    keep[drop] = False
    offsets = np.concatenate([[0], np.cumsum(bytes_of - (left > 0))])
    text = pa.LargeStringArray.from_buffers(
        docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep].tobytes())
    )
    return pa.table(
        {
            "doc_id": ids,
            "n_words": pa.array(words.counts.astype(np.int64)),
            "n_removed": pa.array((words.counts - left).astype(np.int64)),
            "kept_text": text.cast(pa.string()),
        }
    )


def remove_repeated_windows(
    docs: DataFrame, *, size: int = 35, max_cells: int = 1 << 27, bucket_keys: int = 2_000_000
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    packs = write_packs(docs)
    # A word has about six bytes.
    text_chars = packs.agg(F.sum("n_bytes")).first()[0] or 0
    bits = cell_bits(text_chars // 6, max_cells)
    shared = seen_again(packs, _window_keys(size), bits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, int(text_chars // 6 // bucket_keys) + 1)
    answers = materialize(
        packs.mapInArrow(_send(size, bits, buckets, shared), "bucket int, pack long, keys binary, checks binary")
        .groupBy("bucket")
        .applyInArrow(_group, "pack long, bucket int, repeated binary"),
        "window-answers",
    )
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(
        _remove(size, bits, buckets, shared), f"doc_id {kind}, n_words long, n_removed long, kept_text string"
    )
