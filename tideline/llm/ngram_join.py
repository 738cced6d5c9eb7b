"""Near-duplicate documents by an n-gram Jaccard join, as a blocked sparse matrix product.

Rows of the incidence matrix are distinct shingle sets (documents with equal
sets are one row), columns are shingles. Two rows link when their overlap is
at least 80 % of their union.

1. Candidates. Two linked rows of n and m shingles share one of the first
   n - ceil(0.8 n) + 1 of each under any common order of columns. The order
   puts columns that a merged count sketch finds frequent last, so a passage
   that a third of the documents share is never reached by ordinary rows. The
   product over these prefix columns is formed column block by column block:
   a pair stays only while its sizes and the places of the shared column allow
   enough overlap. Columns of up to 64 rows give their pairs, larger ones only
   a forest that connects what they would give, so no group is paired out.
2. Blocks. Connected candidates are gathered, each row's set shipped once.
   A component larger than a block is cut by size class, and only blocks of
   equal or neighbouring classes meet, for others cannot reach 80 %.
3. Product. Inside a block, rows meet columns in dense tiles; overlap counts
   are summed over column tiles, and a tile's work ends once no pair can reach
   its bound with the columns left. Links are exact integer comparisons.

Links leave a block as a forest, and components of all links label the rows.

Defined results: null or wordless text has an empty set, links with nothing
and is its own component; a text of fewer words than a shingle has its whole
sequence as its one shingle; letters A-Z are folded. A component's id is its
least doc_id that is not null. Shingles are compared by 64-bit hashes, sets by
a 64-bit hash of theirs. Repeated rows and ids are ordinary. Only doc_id and
text are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import connect, forest, labels
from tideline.llm.tables import text_of
from tideline.llm.words import (
    Hasher,
    find_words,
    lower_ascii,
    packs,
    run_starts,
    shingle_sets,
    text_bytes,
    visible_bytes,
)
from tideline.session import materialize

_SEED = 53
_SKETCH_BITS = 24
_SLICES = 64
_WIDTH = (1 << _SKETCH_BITS) // _SLICES
#: Bytes of text that are hashed at a time.
_PACK = 1 << 19
#: Shingles that a task holds before it sends their cells.
_HELD = 1 << 19
_LIST = 64
_MATRIX = 1024
_ROWS = 512
_COLUMNS = 4096


def _least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least I with 100 I >= 80 (n + m - I)."""
    return -((-4 * (n + m)) // 9)


def _prefix(n: np.ndarray) -> np.ndarray:
    """n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def _sketch(size: int):
    """Cells of a partition's shingles and how often each is met, slice by slice.

    Only cells that occur are held and sent, ``_HELD`` shingles at a time, so
    a task needs no table of all cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(_SEED)
        waiting, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            cells = np.sort(np.concatenate(waiting))
            waiting.clear()
            held = 0
            first = run_starts(cells)
            counts = np.diff(np.append(first, len(cells))).astype(np.uint32)
            cells = cells[first]
            edge = np.searchsorted(cells, np.arange(_SLICES + 1) * _WIDTH)
            full = np.flatnonzero(np.diff(edge))
            parts = [slice(edge[k], edge[k + 1]) for k in full]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array([zlib.compress((cells[p] % _WIDTH).astype(np.uint32).tobytes(), 1) for p in parts], pa.binary()),
                    pa.array([zlib.compress(counts[p].tobytes(), 1) for p in parts], pa.binary()),
                ],
                names=["slice", "cells", "counts"],
            )

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in packs(offsets, _PACK):
                part = lower_ascii(data[offsets[lo] : offsets[hi]])
                words = find_words(part, offsets[lo : hi + 1] - offsets[lo], visible_bytes())
                whole = hasher.windows(hasher.words(part, words), size)
                whole = whole[words.room()[: len(whole)] >= size]
                waiting.append(_cell(whole).astype(np.int32))
                held += len(whole)
                if held >= _HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted slices summed; each cell's place in the order, an eighth of a doubling a step."""
    now, total = None, None

    def done():
        level = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"]
        )

    for batch in batches:
        for k, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "cells", "counts")), strict=True):
            if k != now:
                if now is not None:
                    yield done()
                now, total = k, np.zeros(_WIDTH, np.int64)
            total[np.frombuffer(zlib.decompress(cells), np.uint32)] += np.frombuffer(zlib.decompress(counts), np.uint32)
    if now is not None:
        yield done()


def _small(values: np.ndarray) -> bytes:
    """Packed as 16-bit numbers where they fit, else as 32-bit."""
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32).tobytes()


def _unsmall(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def _rows(size: int, levels, buckets: int, doc_type: pa.DataType):
    """For each pack its documents' set sizes and signatures, and its prefix entries by column bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, level_of = Hasher(_SEED), levels.value
        step = (1 << 64) // buckets
        edge = np.array([k * step for k in range(1, buckets)], np.uint64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in packs(offsets, _PACK):
                part = lower_ascii(data[offsets[lo] : offsets[hi]])
                sets, first = shingle_sets(part, offsets[lo : hi + 1] - offsets[lo], hasher, size)
                n = np.diff(first)
                sig = hasher.spans(sets, first[:-1], first[1:]).view(np.int64)
                # One row of the matrix for each signature of the pack.
                row = np.zeros(len(n), np.bool_)
                row[np.unique(sig, return_index=True)[1]] = True
                row &= n > 0
                owner = np.repeat(np.arange(len(n)), n)
                value, owner = sets[row[owner]], owner[row[owner]]
                level = level_of[_cell(value)]
                # Sets are ascending already; a stable sort by level keeps that order inside a level.
                order = np.lexsort((level, owner))
                value, owner = value[order], owner[order]
                begin = np.searchsorted(owner, np.arange(len(n)))
                rank = np.arange(len(owner)) - begin[owner]
                head = rank < _prefix(n)[owner]
                value, owner, rank = value[head], owner[head], rank[head]
                order = np.argsort(value, kind="stable")
                value, owner, rank = value[order], owner[order], rank[order]
                cut = np.concatenate([[0], np.searchsorted(value, edge), [len(value)]])
                entries = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    part_of = slice(cut[k], cut[k + 1])
                    who, index = np.unique(owner[part_of], return_inverse=True)
                    entries.append(
                        {
                            "bucket": k,
                            "column": value[part_of].tobytes(),
                            "who": _small(index),
                            "rank": _small(rank[part_of]),
                            "sig": sig[who].tobytes(),
                            "n": _small(n[who]),
                        }
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("doc_id").slice(lo, hi - lo).to_pylist()], pa.list_(doc_type)),
                        pa.array([batch.column("text_key").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                        pa.array([n.astype(np.int64)], pa.list_(pa.int64())),
                        pa.array([sig], pa.list_(pa.int64())),
                        pa.array([entries], pa.list_(_ENTRY)),
                    ],
                    names=["doc_ids", "text_keys", "n", "sig", "entries"],
                )

    return run


_ENTRY = pa.struct(
    [("bucket", pa.int32()), *((c, pa.binary()) for c in ("column", "who", "rank", "sig", "n"))]
)
_ENTRY_SQL = "struct<bucket:int,column:binary,who:binary,rank:binary,sig:binary,n:binary>"


def _may_link(n, m, i, j) -> np.ndarray:
    """Sizes, and places i and j of a shared column, leave room for enough overlap."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= _least_overlap(n, m))


def _column_block(table: pa.Table) -> pa.Table:
    """Candidate pairs of one block of columns, as a forest."""
    column, sig, n, rank = [], [], [], []
    for k in range(table.num_rows):
        c = np.frombuffer(table.column("column")[k].as_py(), np.uint64)
        own = np.frombuffer(table.column("sig")[k].as_py(), np.int64)
        who = _unsmall(table.column("who")[k].as_py(), len(c))
        column.append(c)
        sig.append(own[who])
        n.append(_unsmall(table.column("n")[k].as_py(), len(own))[who])
        rank.append(_unsmall(table.column("rank")[k].as_py(), len(c)))
    column, sig, n, rank = map(np.concatenate, (column, sig, n, rank))
    # Columns of one row only give nothing.
    order = np.argsort(column, kind="stable")
    column = column[order]
    shared = np.zeros(len(column), np.bool_)
    same = column[1:] == column[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    column, order = column[shared], order[shared]
    sig, n, rank = sig[order], n[order], rank[order]
    order = np.lexsort((sig, n, column))
    column, sig, n, rank = column[order], sig[order], n[order], rank[order]
    new = np.ones(len(column), np.bool_)
    new[1:] = (column[1:] != column[:-1]) | (sig[1:] != sig[:-1])
    column, sig, n, rank = column[new], sig[new], n[new], rank[new]
    begin = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(column)))
    room = np.repeat(np.cumsum(length), length) - np.arange(len(column))
    short = np.repeat(length <= _LIST, length)
    a, b = [], []
    for step in range(1, min(_LIST, int(length.max(initial=0)))):
        i = np.flatnonzero(short & (room > step))
        if not len(i):
            break
        i = i[_may_link(n[i], n[i + step], rank[i], rank[i + step])]
        a.append(sig[i])
        b.append(sig[i + step])
        if len(a) >= 16:
            a, b = map(lambda x: [x], forest(np.concatenate(a), np.concatenate(b)))
    for s, m in zip(begin[length > _LIST], length[length > _LIST], strict=True):
        own, size, place = sig[s : s + m], n[s : s + m], rank[s : s + m]
        if m <= _MATRIX:
            pair = _may_link(size[:, None], size[None, :], place[:, None], place[None, :])
            i, j = np.nonzero(np.triu(pair, 1))
            x, y = forest(own[i], own[j]) if len(i) else (own[:0], own[:0])
        else:
            # In order of size, neighbours too far apart in size part the list.
            near = np.flatnonzero(5 * size[:-1] >= 4 * size[1:])
            x, y = own[near], own[near + 1]
        a.append(x)
        b.append(y)
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (sig[:0], sig[:0])
    a, b = forest(a, b)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _wanted_sets(size: int, wanted):
    """Signature and set of the documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(_SEED), wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("cell").to_numpy()]))
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in packs(offsets, _PACK):
                part = lower_ascii(data[offsets[lo] : offsets[hi]])
                sets, first = shingle_sets(part, offsets[lo : hi + 1] - offsets[lo], hasher, size)
                sig = hasher.spans(sets, first[:-1], first[1:]).view(np.int64)
                one = np.unique(sig, return_index=True)[1]
                one = one[np.diff(first)[one] > 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sig[one]),
                        pa.array([sets[first[k] : first[k + 1]].tobytes() for k in one], pa.binary()),
                    ],
                    names=["sig", "shingles"],
                )

    return run


def _product(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows: overlap counts summed over column tiles, row tile by row tile."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    value = np.concatenate([sets[k] for k in order])
    n = n[order]
    row = np.repeat(np.arange(len(n)), n)
    column, index, often = np.unique(value, return_inverse=True, return_counts=True)
    # A column of one row adds to no overlap.
    number = np.cumsum(often > 1) - 1
    keep = often[index] > 1
    row, col = row[keep], number[index[keep]]
    columns = int((often > 1).sum())
    by_tile = np.lexsort((row, col // _COLUMNS))
    row, col = row[by_tile], col[by_tile]
    tile_edge = np.searchsorted(col // _COLUMNS, np.arange(-(-columns // _COLUMNS) + 1))
    a, b = [], []
    for r in range(0, len(n), _ROWS):
        rows = slice(r, min(r + _ROWS, len(n)))
        for s in range(r, len(n), _ROWS):
            others = slice(s, min(s + _ROWS, len(n)))
            if 5 * n[rows.stop - 1] < 4 * n[s]:
                break  # every row from here on is too long for these
            need = _least_overlap(n[rows, None], n[None, others])
            fits = 5 * n[rows, None] >= 4 * n[None, others]
            if r == s:
                fits &= np.triu(np.ones(fits.shape, np.bool_), 1)
            # A tile's product is exact in 32 bits, as it is narrower than 2^24; the sum needs whole numbers.
            overlap = np.zeros(fits.shape, np.int64)
            left_x, left_y = (np.bincount(row, minlength=len(n))[x].astype(np.int64) for x in (rows, others))
            for t in range(len(tile_edge) - 1):
                within = slice(tile_edge[t], tile_edge[t + 1])
                x, used_x = _tile(row[within], col[within] - t * _COLUMNS, rows, min(_COLUMNS, columns - t * _COLUMNS))
                y, used_y = (x, used_x) if r == s else _tile(
                    row[within], col[within] - t * _COLUMNS, others, min(_COLUMNS, columns - t * _COLUMNS)
                )
                overlap += (x @ y.T).astype(np.int64)
                left_x, left_y = left_x - used_x, left_y - used_y
                if not (fits & (overlap + np.minimum(left_x[:, None], left_y[None, :]) >= need)).any():
                    break
            i, j = np.nonzero(fits & (overlap >= need))
            a.append(order[r + i])
            b.append(order[s + j])
    return (np.concatenate(a), np.concatenate(b)) if a else (order[:0], order[:0])


def _tile(row: np.ndarray, col: np.ndarray, rows: slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense tile of the incidence matrix, and how many entries each row has in it."""
    lo, hi = np.searchsorted(row, rows.start), np.searchsorted(row, rows.stop)
    tile = np.zeros((rows.stop - rows.start, width), np.float32)
    tile[row[lo:hi] - rows.start, col[lo:hi]] = 1
    return tile, np.bincount(row[lo:hi] - rows.start, minlength=rows.stop - rows.start)


def _block(table: pa.Table) -> pa.Table:
    """Links of one block's rows, component by component, as a forest."""
    component = table.column("component").to_numpy()
    sig = table.column("sig").to_numpy()
    order = np.lexsort((sig, component))
    new = np.ones(len(order), np.bool_)
    new[1:] = sig[order][1:] != sig[order][:-1]
    order = order[new]
    edge = np.flatnonzero(np.concatenate([[True], np.diff(component[order]) != 0, [True]]))
    a, b = [], []
    shingles = table.column("shingles").combine_chunks()
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        rows = order[lo:hi]
        if len(rows) < 2:
            continue
        i, j = _product([np.frombuffer(shingles[int(k)].as_buffer(), np.uint64) for k in rows])
        root = labels(len(rows), i, j)
        other = np.flatnonzero(root != np.arange(len(rows)))
        a.append(sig[rows[other]])
        b.append(sig[rows[root[other]]])
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (sig[:0], sig[:0])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with the block or blocks in which they meet; ``rows`` has sig, component, n."""
    # Class k holds sizes from 1.25^k; linked rows are of equal or neighbouring classes.
    rows = rows.withColumn("class", F.floor(F.log(F.col("n")) / math.log(1.25) + 1e-9).cast("int"))
    classes = rows.groupBy("component", "class").agg(F.sum("n").alias("weight"))
    whole = classes.groupBy("component").agg(F.sum("weight").alias("whole"))
    parts = classes.join(whole, "component").select(
        "component", "class", "whole", F.ceil(F.col("weight") * 2 / limit).cast("int").alias("parts")
    )

    def beside(step: int) -> DataFrame:
        return parts.select("component", (F.col("class") + step).alias("class"), F.col("parts").alias(f"beside{step + 1}"))

    placed = (
        rows.join(parts, ["component", "class"])
        .join(beside(1), ["component", "class"], "left")
        .join(beside(-1), ["component", "class"], "left")
        .withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    )
    small = F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.col("bundles"))))
    total = placed.agg(F.sum("n").alias("total")).select(F.ceil(F.col("total") * 2 / limit).alias("bundles"))
    # One row: how many bundles the small components fill.
    bundles = total.first()[0] or 1

    def meet(lower_class, lower_part, upper_part, name):
        return F.concat_ws("/", F.lit(name), "component", lower_class, lower_part, upper_part)

    mine = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: meet(F.col("class"), F.least(F.col("part"), q), F.greatest(F.col("part"), q), "e"),
    )
    up = F.when(
        F.col("beside0").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("beside0") - 1), lambda q: meet(F.col("class"), F.col("part"), q, "n")),
    ).otherwise(F.array().cast("array<string>"))
    down = F.when(
        F.col("beside2").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("beside2") - 1), lambda q: meet(F.col("class") - 1, q, F.col("part"), "n")),
    ).otherwise(F.array().cast("array<string>"))
    placed = placed.withColumn("bundles", F.lit(max(1, int(bundles))))
    return placed.select(
        "sig", "component",
        F.explode(F.when(F.col("whole") <= limit, small).otherwise(F.concat(mine, up, down))).alias("block"),
    )


def near_duplicates(docs: DataFrame, *, shingle: int = 5, block_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    ``text_key`` is a hash of the text that tells rows of one id apart;
    ``label`` is equal in a component and null where the set is empty.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    text = docs.select("doc_id", text_of("text").alias("text"), F.xxhash64(text_of("text")).alias("text_key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = np.zeros(1 << _SKETCH_BITS, np.uint8)
    slices = (
        text.select("text").mapInArrow(_sketch(shingle), "slice int, cells binary, counts binary")
        .repartition(2 * _SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_levels, "slice int, levels binary")
    )
    for k, raw in slices.toLocalIterator():  # a table of 16 megabytes
        order[k * _WIDTH : (k + 1) * _WIDTH] = np.frombuffer(raw, np.uint8)
    levels = spark.sparkContext.broadcast(order)
    chars = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, int(chars // 30_000_000) + 1)
    packed = materialize(
        text.mapInArrow(
            _rows(shingle, levels, buckets, to_arrow_type(kind)),
            f"doc_ids array<{kind.simpleString()}>, text_keys array<long>, n array<long>, sig array<long>, "
            f"entries array<{_ENTRY_SQL}>",
        ),
        "shingle-rows",
    )
    rows = packed.select(F.explode(F.arrays_zip("doc_ids", "text_keys", "n", "sig")).alias("d")).select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"),
        F.col("d.n").alias("n"), F.col("d.sig").alias("sig"),
    )
    candidates = (
        packed.select(F.explode("entries").alias("e")).select("e.*")
        .groupBy("bucket").applyInArrow(_column_block, "a long, b long")
    )
    gathered = connect(candidates)
    one_each = rows.where("n > 0").groupBy("sig").agg(F.min("n").alias("n"), F.min(F.struct("doc_id")).alias("d"))
    chosen = materialize(
        one_each.join(gathered, one_each["sig"] == gathered["node"]).select(
            "sig", "n", F.col("label").alias("component"), F.col("d.doc_id").alias("doc_id")
        ),
        "candidate-rows",
    )
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 22)).cast("int").alias("cell")
    bits = np.zeros(1 << 22, np.bool_)
    for (k,) in chosen.select(cell).distinct().toLocalIterator():  # at most 2^22 numbers
        bits[k] = True
    sets = text.select(cell, "text").mapInArrow(
        _wanted_sets(shingle, spark.sparkContext.broadcast(bits)), "sig long, shingles binary"
    )
    links = (
        sets.join(_in_blocks(chosen.select("sig", "component", "n"), block_shingles), "sig")
        .select("block", "component", "sig", "shingles")
        .groupBy("block").applyInArrow(_block, "a long, b long")
    )
    linked = connect(links)
    labelled = rows.join(linked, rows["sig"] == linked["node"], "left").select(
        "doc_id", "text_key", "n", F.coalesce("label", "sig").alias("label")
    )
    least = labelled.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return (
        labelled.withColumn("label", F.when(F.col("n") > 0, F.col("label")))
        .join(least, "label", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            "text_key", "label",
        )
    )
