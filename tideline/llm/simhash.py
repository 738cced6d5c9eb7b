"""SimHash fingerprints of documents, and components of near fingerprints by BK-trees.

1. A document's fingerprint: bit k is 1 if it is set in over half the XXH64
   hashes of the document's 3-word shingles. Equal fingerprints are one from
   then on, so copies cost nothing further.
2. Shards. Two fingerprints within ``radius`` bits agree on a whole third of
   any bits taken (on a (radius + 1)-th, in general). So fingerprints are
   dealt to groups by the leading bits of each third, as many bits as make
   groups of about ``tree_size``. A group that is still larger than
   ``limit``, as one of near copies is, is dealt again by the whole third, then
   by each third of the bits that are left, and so on. The bits run out after
   a few rounds, so every group is bounded whatever the fingerprints are, and
   no pair within the radius is lost.
3. Trees. A shard's task builds a BK-tree for each of its groups. The trees are
   written to the shared folder. If all of them take at most
   ``broadcast_bytes`` they are broadcast and every partition of the
   fingerprints searches them; beyond that the fingerprints of a shard search
   its trees where they are. Both follow only the edges within the radius.
4. Links become components (``components.connect``).

Defined results: null or wordless text has fingerprint zero and links like any
other; a text of one or two words has its whole sequence as its one shingle;
letters A-Z are folded. A component's id is its least doc_id that is not null.
Repeated rows and ids are ordinary. A text of any length is hashed whole, a
million shingles at a time. Only doc_id and text are read, so other columns may
have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bk_tree import Forest, build
from tideline.llm.components import connect, forest
from tideline.llm.tables import text_of
from tideline.llm.words import find_words, lower_ascii, packs, text_bytes, visible_bytes
from tideline.session import materialize

SHINGLE = 3
SEED = 42
_BITS = 64
_LAST_BITS = 13
_CHUNK = 1 << 18


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words each followed by one blank; where they start and end; the first word of each document."""
    words = find_words(data, offsets, visible_bytes())
    width = words.end - words.start + 1
    end = np.cumsum(width)
    source = np.repeat(words.start - (end - width), width) + np.arange(int(width.sum()))
    body = np.append(data, np.uint8(0x20))[np.minimum(source, len(data))]
    body[end - 1] = 0x20
    return body, end - width, end - 1, words.first


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The SimHash of each document's shingles; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    body, start, end, first = joined_words(lower_ascii(data), offsets)
    raw = memoryview(body)
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    # A document's shingles follow each other: their words, and where the document's begin.
    begin = np.cumsum(shingles) - shingles
    owner = np.repeat(np.arange(len(count)), shingles)
    word = np.arange(len(owner)) - begin[owner] + first[owner]
    last = np.minimum(word + size, first[owner + 1]) - 1
    ones = np.zeros((len(count), _BITS), np.int64)
    for k in range(0, len(owner), _CHUNK):
        part = slice(k, k + _CHUNK)
        pairs = zip(start[word[part]].tolist(), end[last[part]].tolist(), strict=True)
        h = np.fromiter((digest(raw[a:b], SEED) for a, b in pairs), np.uint64, len(word[part]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = owner[part]
        edge = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        ones[who[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    over = 2 * ones > shingles[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out = [
            fingerprints(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for lo, hi in packs(offsets)
        ]
        value = np.concatenate(out) if out else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(value.view(np.int64))], names=["doc_id", "fingerprint"]
        )


def simhash_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document, as the signed long of its 64 bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        _fingerprints, f"doc_id {kind}, fingerprint long"
    )


def _parts(taken: int, n: int) -> list[list[int]]:
    """The bits that are not in the mask, highest first, in n runs of nearly equal length."""
    left = [b for b in reversed(range(_BITS)) if not taken >> b & 1]
    edge = [len(left) * k // n for k in range(n + 1)]
    return [left[edge[k] : edge[k + 1]] for k in range(n)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def first_masks(n: int, radius: int, tree_size: int) -> dict[int, int]:
    """Masks of leading bits that make groups of about ``tree_size`` of n; by each its whole part."""
    lead = max(0, math.ceil(math.log2(max(n, 1) / tree_size)))
    if lead == 0:
        return {0: 0}
    return {_mask(part[:lead]): _mask(part) for part in _parts(0, radius + 1)}


def finer_masks(masks: dict[int, int], radius: int) -> dict[int, dict[int, int]]:
    """For each mask the masks that deal its groups again, by each its whole part.

    A mask of leading bits gives way to its whole part; a whole part to itself
    with each of the radius + 1 parts of the bits left, while more than
    ``_LAST_BITS`` are: a group has at most 2^13 members then.
    """
    out = {}
    for mask, whole in masks.items():
        if mask != whole:
            out[mask] = {whole: whole}
        elif _BITS - whole.bit_count() > _LAST_BITS:
            out[mask] = {whole | _mask(part): whole | _mask(part) for part in _parts(whole, radius + 1)}
    return out


def _signed(value: int) -> int:
    return value - (1 << _BITS) if value >> (_BITS - 1) else value


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    """Each fingerprint once for each of its masks: value, mask, and the bits it has there."""
    dealt = rows.select("value", F.explode(masks).alias("mask"))
    return dealt.withColumn("key", F.col("value").bitwiseAND(F.col("mask")))


def _longs(masks) -> Column:
    return F.array(*(F.lit(_signed(m)).cast("long") for m in masks))


def _groups(values: DataFrame, n: int, radius: int, tree_size: int, limit: int) -> DataFrame:
    """value, mask and key of every fingerprint in every group of two or more that is not dealt again."""
    masks = first_masks(n, radius, tree_size)
    rows, done = _dealt(values, _longs(masks)), None
    while True:
        rows = materialize(rows, "dealt")
        sizes = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")), "group-sizes")
        finer = finer_masks(masks, radius)
        # The masks of large groups: at most radius + 1 to the power of the round.
        hot = {r[0] for r in sizes.where(F.col("n") > limit).select("mask").distinct().collect()} if finer else set()
        finer = {m: children for m, children in finer.items() if _signed(m) in hot}
        again = (F.col("n") > limit) & F.col("mask").isin(*map(_signed, finer)) if finer else F.lit(False)
        sized = rows.join(sizes, ["mask", "key"])
        ready = sized.where((F.col("n") > 1) & ~again).select("value", "mask", "key")
        done = ready if done is None else done.unionByName(ready)
        if not finer:
            return done
        children = F.create_map(*(x for m, c in finer.items() for x in (F.lit(_signed(m)).cast("long"), _longs(c))))
        # A fingerprint may be dealt to one group from several.
        rows = _dealt(sized.where(again), children[F.col("mask")]).distinct()
        masks = {m: whole for c in finer.values() for m, whole in c.items()}


def _group_of(mask: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of rows, and a row of each."""
    order = np.lexsort((key, mask))
    new = np.ones(len(order), np.bool_)
    new[1:] = (mask[order][1:] != mask[order][:-1]) | (key[order][1:] != key[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _plant(table: pa.Table) -> pa.Table:
    """The trees of one shard as one row."""
    value = table.column("value").to_numpy().view(np.uint64)
    mask, key = table.column("mask").to_numpy(), table.column("key").to_numpy()
    order = np.argsort(value, kind="stable")
    value, mask, key = value[order], mask[order], key[order]
    number, sample = _group_of(mask, key)
    trees, roots = build(value, number)
    chosen = sample[roots]
    return pa.table(
        {
            "shard": table.column("shard").slice(0, 1),
            "root_mask": pa.array([mask[chosen]], pa.list_(pa.int64())),
            "root_key": pa.array([key[chosen]], pa.list_(pa.int64())),
            "nodes": pa.array([trees.value.tobytes()], pa.binary()),
            "edges": pa.array([trees.child_key.tobytes()], pa.binary()),
        }
    )


_TREES = "shard long, root_mask array<long>, root_key array<long>, nodes binary, edges binary"
Shard = tuple[np.ndarray, np.ndarray, Forest]


def _shard_of(row) -> Shard:
    """Masks and keys of the roots, in ascending order, and the trees."""
    mask, key = (np.array(row[c], np.int64) for c in ("root_mask", "root_key"))
    trees = Forest(np.frombuffer(row["nodes"], np.uint64), np.frombuffer(row["edges"], np.int64), len(mask))
    return mask, key, trees


def _links(value: np.ndarray, shard: Shard, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links between the fingerprints and the nodes of a shard's trees."""
    mask, key, trees = shard
    a, b = [], []
    # Roots are numbered in the order of (mask, key), so those of one mask are a range.
    for m in np.unique(mask):
        lo, hi = np.searchsorted(mask, m, "left"), np.searchsorted(mask, m, "right")
        want = value.view(np.int64) & m
        at = lo + np.searchsorted(key[lo:hi], want)
        here = np.flatnonzero((at < hi) & (key[np.minimum(at, hi - 1)] == want))
        for k in range(0, len(here), _CHUNK):
            some = here[k : k + _CHUNK]
            query, node = trees.search(value[some], at[some], radius)
            other = trees.value[node]
            apart = value[some][query] != other
            x, y = forest(value[some][query][apart].view(np.int64), other[apart].view(np.int64))
            a.append(x)
            b.append(y)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _search_all(shards, radius: int):
    """Links of a partition's fingerprints with broadcast trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planted = [_shard_of(row) for row in shards.value]
        for batch in batches:
            value = batch.column("value").to_numpy().view(np.uint64)
            for shard in planted:
                yield _link_batch(*_links(value, shard, radius))

    return run


def _search_own(radius: int):
    """Links of a shard's fingerprints with its own trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _shard_of(row)
                yield _link_batch(*_links(np.unique(shard[2].value), shard, radius))

    return run


def link_fingerprints(
    values: DataFrame, *, radius: int = 2, tree_size: int = 1 << 12, limit: int = 1 << 14,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """a, b: links that connect whatever distinct fingerprints ``value`` are within the radius."""
    spark = values.sparkSession
    n = values.count()
    members = _groups(values, n, radius, tree_size, limit)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (radius + 1) * n // tree_size + 1)
    shard = F.pmod(F.xxhash64("mask", "key"), F.lit(shards)).alias("shard")
    trees = materialize(members.select(shard, "value", "mask", "key").groupBy("shard").applyInArrow(_plant, _TREES), "bk-trees")
    size = trees.agg(F.sum(F.octet_length("nodes") + F.octet_length("edges") + 16 * F.size("root_key"))).first()[0] or 0
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast([r.asDict() for r in trees.toLocalIterator()])
        return values.mapInArrow(_search_all(shared, radius), "a long, b long")
    return trees.mapInArrow(_search_own(radius), "a long, b long")


def near_fingerprints(docs: DataFrame, *, radius: int = 2, **limits: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and label of every document.

    ``label`` is equal in a component, whatever the ids are.
    """
    rows = materialize(simhash_documents(docs), "fingerprints")
    distinct = materialize(
        rows.groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("least")), "distinct-fingerprints"
    )
    linked = connect(link_fingerprints(distinct.select("value"), radius=radius, **limits))
    labelled = distinct.join(linked, distinct["value"] == linked["node"], "left").select(
        "value", "least", F.coalesce("label", "value").alias("label")
    )
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.join(ids, "label").select("value", "label", "component_id")
    return rows.join(classes, rows["fingerprint"] == classes["value"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "label"
    )
