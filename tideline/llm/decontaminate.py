"""Benchmark passages in documents, by a prefix-filtered set join of shingles.

Every item is cut into windows of ten consecutive words (a shorter item is one
window). A window is the set of its five-word shingles; as a document must
hold the whole window, sharing its single rarest shingle is necessary, and so
only that one is joined. Rarity comes from counts over all documents; a window
one of whose shingles no document has is dropped. A match of the shingle at a
place gives the only place where the window can start; it must have room in
its document (length and positional bound), its hash must agree there, and
last its words themselves.

Documents are only scanned, never shuffled, so hot sources and common passages
cost no more than their text. The benchmark is the stated query set: its items
go in blocks of ``block_chars`` characters, each block a broadcast of bounded
size, and a document's hits and items are gathered over the blocks.

Defined results: null or wordless texts are not hit and hit nothing; repeated
items hit once; an item without an id hits words but has no id to report. An
empty benchmark or an empty table leaves every document clean. Columns called
like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import (
    Hasher,
    Words,
    find_words,
    letter_bytes,
    lower_ascii,
    packs,
    text_bytes,
)

RESULTS = ("n_words", "hits", "items", "n_hit", "n_items", "contaminated")
SHINGLE = 5
_FILTER_BITS = 20


@dataclass
class Windows:
    """The windows of one block of items, and after the count their prefixes."""

    words: list[tuple[bytes, ...]]
    items: list[list[str]]
    hashes: np.ndarray
    sizes: np.ndarray
    #: Distinct shingles, ascending, with the number of words of each.
    shingles: np.ndarray
    widths: np.ndarray
    #: Of every window and offset: the window, the offset, the shingle.
    window: np.ndarray
    offset: np.ndarray
    shingle: np.ndarray


def _words_of(texts: list[str | None], size: int) -> Iterator[tuple[int, tuple[bytes, ...]]]:
    column = pa.array(texts, pa.string())
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    words = find_words(data, offsets, letter_bytes())
    raw = data.tobytes()
    for k in range(len(texts)):
        own = [raw[a:b] for a, b in zip(words.start[words.first[k] : words.first[k + 1]], words.end[words.first[k] : words.first[k + 1]], strict=True)]
        if own:
            for i in range(max(1, len(own) - size + 1)):
                yield k, tuple(own[i : i + size])


def build_windows(items: list[tuple[str | None, str | None]], size: int, hasher: Hasher) -> Windows:
    """Distinct windows of the items of a block."""
    owners: dict[tuple[bytes, ...], set] = {}
    for k, window in _words_of([text for _, text in items], size):
        owners.setdefault(window, set()).add(items[k][0])
    found = list(owners)
    flat = b"".join(w for window in found for w in window)
    ends = np.cumsum(np.array([len(w) for window in found for w in window], np.int64))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    words = hasher.strings(np.frombuffer(flat, np.uint8), starts.astype(np.int64), ends)
    sizes = np.array([len(w) for w in found], np.int64)
    last = np.cumsum(sizes)
    first = last - sizes
    width = np.minimum(sizes, SHINGLE)
    places = sizes - width + 1
    window = np.repeat(np.arange(len(found)), places)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(places) - places, places)
    begin = first[window] + offset
    shingle = hasher.spans(words, begin, begin + width[window]) if len(found) else np.zeros(0, np.uint64)
    distinct, sample, index = np.unique(shingle, return_index=True, return_inverse=True)
    return Windows(
        found, [sorted(i for i in owners[w] if i is not None) for w in found],
        hasher.spans(words, first, last) if len(found) else np.zeros(0, np.uint64), sizes,
        distinct, width[window][sample], window, offset, index,
    )


class _Lookup:
    """Places where a document has one of some shingles."""

    def __init__(self, shingles: np.ndarray, widths: np.ndarray):
        self.by_width = {}
        for width in np.unique(widths).tolist():
            number = np.flatnonzero(widths == width)
            bits = np.zeros(1 << _FILTER_BITS, np.bool_)
            bits[(shingles[number] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_width[width] = (number, shingles[number], bits)

    def find(self, hashes: np.ndarray, room: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
        """Word places and the numbers of the shingles that start there."""
        at, which = [], []
        for width, (number, values, bits) in self.by_width.items():
            here = hasher.windows(hashes, width)
            near = np.flatnonzero(bits[(here >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            near = near[room[near] >= width]
            place = np.minimum(np.searchsorted(values, here[near]), len(values) - 1)
            same = values[place] == here[near]
            at.append(near[same])
            which.append(number[place[same]])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(which)


def _scan(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, Words, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in packs(offsets):
        part = lower_ascii(data[offsets[lo] : offsets[hi]])
        words = find_words(part, offsets[lo : hi + 1] - offsets[lo], letter_bytes())
        yield lo, hi, part, words, hasher.words(part, words)


def _count(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, hasher = shared.value, Hasher(seed)
        lookup = _Lookup(windows.shingles, windows.widths)
        total = np.zeros(len(windows.shingles), np.int64)
        for batch in batches:
            for _, _, _, words, hashes in _scan(batch, hasher):
                total += np.bincount(lookup.find(hashes, words.room(), hasher)[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

    return run


def _rarest(windows: Windows, counts: np.ndarray) -> np.ndarray:
    """For each window the entry with its rarest shingle, where all its shingles occur."""
    n = counts[windows.shingle]
    order = np.lexsort((windows.offset, n, windows.window))
    first = order[np.searchsorted(windows.window[order], np.arange(len(windows.words)))]
    return first[n[first] > 0] if len(first) else first


def _hits(shared, chosen_shared, seed: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, chosen, hasher = shared.value, chosen_shared.value, Hasher(seed)
        by_shingle = chosen[np.argsort(windows.shingle[chosen], kind="stable")]
        number = windows.shingle[by_shingle]
        wanted, begin = np.unique(number, return_index=True)
        end = np.append(begin[1:], len(number))
        lookup = _Lookup(windows.shingles[wanted], windows.widths[wanted])
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            hits: list = [None] * batch.num_rows
            items: list = [None] * batch.num_rows
            for lo, hi, data, words, hashes in _scan(batch, hasher):
                counts[lo:hi] = words.counts
                room = words.room()
                at, which = lookup.find(hashes, room, hasher)
                repeat = end[which] - begin[which]
                entry = by_shingle[
                    np.repeat(begin[which], repeat)
                    + np.arange(repeat.sum())
                    - np.repeat(np.cumsum(repeat) - repeat, repeat)
                ]
                start = np.repeat(at, repeat) - windows.offset[entry]
                window = windows.window[entry]
                size = windows.sizes[window]
                owner = words.document()
                keep = start >= 0
                keep[keep] &= room[start[keep]] >= size[keep]
                start, window, size = start[keep], window[keep], size[keep]
                keep = hasher.spans(hashes, start, start + size) == windows.hashes[window]
                raw = data.tobytes()
                found: dict[int, list] = {}
                for s, w in zip(start[keep].tolist(), window[keep].tolist(), strict=True):
                    own = windows.words[w]
                    if all(
                        raw[words.start[s + i] : words.end[s + i]] == own[i] for i in range(len(own))
                    ):
                        found.setdefault(int(owner[s]), []).append((s, w))
                for k, pairs in found.items():
                    base, n = int(words.first[k]), int(words.counts[k])
                    mark = np.zeros(n + 1, np.int64)
                    for s, w in pairs:
                        mark[s - base] += 1
                        mark[s - base + len(windows.words[w])] -= 1
                    inside = np.cumsum(mark[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]).astype(np.int8)))
                    hits[lo + k] = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                    items[lo + k] = sorted({i for _, w in pairs for i in windows.items[w]})
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in columns),
                    pa.array(counts),
                    pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*columns, "n_words", "__hits", "__items"],
            )

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of bounded size; one block is in memory at a time."""
    block, used = [], 0
    for item in benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        block.append((item[0], item[1]))
        used += len(item[1] or "")
        if used >= limit:
            yield block
            block, used = [], 0
    yield block


def _union(hits, more):
    """Word ranges of both lists; those that touch or overlap are one."""
    ordered = F.array_sort(F.concat(hits, more))
    return F.aggregate(
        ordered,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, size: int = 10, block_chars: int = 16_000_000, seed: int = 7
) -> DataFrame:
    """Documents with their hit word ranges, the items that hit them, and counts of both."""
    spark = docs.sparkSession
    other = [c for c in docs.columns if c not in RESULTS]
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    df = docs.select(*other).withColumns(
        {"n_words": F.lit(0).cast("long"), "hits": nothing, "items": F.array().cast("array<string>")}
    )
    for block in _blocks(benchmark, block_chars):
        windows = build_windows(block, size, Hasher(seed))
        shared = spark.sparkContext.broadcast(windows)
        # At most one row for each shingle of the block.
        rows = (
            docs.select("text").mapInArrow(_count(shared, seed), "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n")).collect()
        )
        counts = np.zeros(len(windows.shingles), np.int64)
        for shingle, n in rows:
            counts[shingle] = n
        chosen = spark.sparkContext.broadcast(_rarest(windows, counts))
        keep = [*other, "hits", "items"]
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
        schema = ", ".join(
            [*fields, "n_words long, __hits array<struct<start:long,end:long>>, __items array<string>"]
        )
        df = df.select(*keep).mapInArrow(_hits(shared, chosen, seed, keep), schema)
        df = df.select(
            *other, "n_words",
            F.when(F.col("__hits").isNull(), F.col("hits")).otherwise(_union(F.col("hits"), F.col("__hits"))).alias("hits"),
            F.when(F.col("__items").isNull(), F.col("items")).otherwise(F.array_union("items", "__items")).alias("items"),
        )
    return df.select(
        *other, "n_words", "hits", F.array_sort("items").alias("items"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        (F.size("hits") > 0).alias("contaminated"),
    )
