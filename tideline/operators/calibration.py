"""Monotone calibration of scores, fitted and applied as tables.

The isotonic fit pools neighbouring scores whose mean labels fall. Blocks that
are pooled within some part of the order stay pooled in the whole, so pooling
goes level by level: inside every fine cell of values, then inside every coarse
cell over what the fine ones left. What is left at last are blocks that rise
inside every coarse cell. A block that lies above every earlier cell and below
every later one is final; the others are pooled between such blocks. The
knots, two for each block at most, are a table and never come to the driver.

Applying them is a lookup of the last knot at or before a score, by value
cell: knots and scores meet by the cell of their value, and a cell carries the
last block before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.prefix import one_row, running, value_cells
from tideline.session import materialize

_BLOCKS = "lo double, hi double, w double, s double"


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool adjacent violators among blocks in order: until means rise strictly.

    Whole runs of blocks that don't rise are pooled at a time while that helps;
    what remains goes block by block, which takes linear time.
    """
    for _ in range(16):
        mean = s / w
        starts = np.flatnonzero(np.concatenate([[True], mean[1:] > mean[:-1]])) if len(s) else np.zeros(0, np.int64)
        if len(starts) == len(s):
            return lo, hi, w, s
        end = np.append(starts[1:], len(s)) - 1
        lo, hi, w, s = lo[starts], hi[end], np.add.reduceat(w, starts), np.add.reduceat(s, starts)
    kept: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist(), strict=True):
        now = list(block)
        while kept and kept[-1][3] * now[2] >= now[3] * kept[-1][2]:
            last = kept.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        kept.append(now)
    return tuple(np.array(c) for c in zip(*kept, strict=True))


def pool_runs(run: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """``pool`` for many runs of blocks at once; ``run`` is their number, rising, and comes back with the blocks."""
    for _ in range(16):
        mean = s / w
        rises = np.concatenate([[True], (mean[1:] > mean[:-1]) | (run[1:] != run[:-1])]) if len(s) else np.zeros(0, np.bool_)
        starts = np.flatnonzero(rises)
        if len(starts) == len(s):
            return run, lo, hi, w, s
        end = np.append(starts[1:], len(s)) - 1
        run, lo, hi, w, s = run[starts], lo[starts], hi[end], np.add.reduceat(w, starts), np.add.reduceat(s, starts)
    mean = s / w
    falls = np.unique(run[1:][(mean[1:] <= mean[:-1]) & (run[1:] == run[:-1])])
    done = ~np.isin(run, falls)
    parts = [(run[done], lo[done], hi[done], w[done], s[done])]
    for r in falls.tolist():
        a, b = np.searchsorted(run, [r, r + 1])
        own = pool(lo[a:b], hi[a:b], w[a:b], s[a:b])
        parts.append((np.full(len(own[0]), r), *own))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _pool_by(keys: Sequence[str]):
    """Pool the blocks of each run of equal keys; rows come sorted by keys and place."""
    columns = ["lo", "hi", "w", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            held = [np.concatenate(c) for c in zip(*rows, strict=True)]
            own, blocks = held[: len(keys)], held[len(keys) :]
            new = np.concatenate([[False], np.logical_or.reduce([c[1:] != c[:-1] for c in own])])
            first = np.flatnonzero(np.concatenate([[True], new[1:]]))
            of, *pooled = pool_runs(np.cumsum(new), *blocks)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*(k[first[of]] for k in own), *pooled)], names=[*keys, *columns])

        # The last run of a batch may go on in the next one.
        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, *columns)]
            own = rows[: len(keys)]
            if waiting and any(c[0] != w[-1] for c, w in zip(own, waiting[-1])):
                yield flush(waiting)
                waiting = []
            differs = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in own]))
            cut = differs[-1] + 1 if len(differs) else 0
            if cut:
                yield flush([*waiting, [c[:cut] for c in rows]])
                waiting = []
            waiting.append([c[cut:] for c in rows])
        if waiting:
            yield flush(waiting)

    return run


def _pooled(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks after pooling inside every value of the keys."""
    schema = ", ".join(f"{k} long" for k in keys)
    rows = blocks.select(*keys, "lo", "hi", "w", "s").repartition(*keys).sortWithinPartitions(*keys, "lo")
    return rows.mapInArrow(_pool_by(keys), f"{schema}, {_BLOCKS}")


def _final(blocks: DataFrame) -> DataFrame:
    """Blocks that rise inside every ``coarse`` cell, pooled across cells."""
    mean = F.col("s") / F.col("w")
    cells = blocks.groupBy("coarse").agg(F.min(mean).alias("least"), F.max(mean).alias("most"))
    # One row a coarse cell, of which there are a thousand for each power of two.
    order = Window.partitionBy(F.lit(0)).orderBy("coarse")
    around = cells.select(
        "coarse",
        F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("least").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    rise = (F.col("before").isNull() | (mean > F.col("before"))) & (F.col("after").isNull() | (mean < F.col("after")))
    judged = materialize(
        blocks.join(around, "coarse").select("lo", "hi", "w", "s", rise.alias("final"), rise.cast("long").alias("one")),
        "isotonic-blocks",
    )
    # Between two final blocks in order lies one stretch that is pooled by itself.
    stretch = running(judged, cells=value_cells(F.col("lo")), order=["lo"], sums=["one"])
    left = stretch.where("NOT final").select(F.col("one_before").alias("stretch"), "lo", "hi", "w", "s")
    done = judged.where("final").select("lo", "hi", "w", "s")
    return done.unionByName(_pooled(left, ["stretch"]).select("lo", "hi", "w", "s"))


def fit_isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """Monotone fit of the label on the score, as blocks: lo, hi, calibrated, weight.

    A block holds the scores from lo to hi, which share a value. Rows without a
    score or a label teach nothing.
    """
    value = F.col(score).cast("double")
    known = value.isNotNull() & ~F.isnan(value) & F.col(label).isNotNull()
    merged = df.where(known).groupBy(value.alias("lo")).agg(
        F.count("*").cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("s")
    )
    coarse, fine = value_cells(F.col("lo"))
    first = merged.select(coarse.alias("coarse"), fine.alias("fine"), "lo", F.col("lo").alias("hi"), "w", "s")
    inside = _pooled(first, ["coarse", "fine"])
    blocks = materialize(_pooled(inside, ["coarse"]), "isotonic-cells")
    fitted = _final(blocks).select("lo", "hi", (F.col("s") / F.col("w")).alias("calibrated"), F.col("w").alias("weight"))
    return materialize(fitted, "isotonic-knots")


def _linked(blocks: DataFrame) -> DataFrame:
    """Blocks with the end and value of the one before, and the start and value of the next."""
    ranked = running(
        blocks.select("lo", "hi", F.col("calibrated").alias("y"), F.lit(1).alias("one")),
        cells=value_cells(F.col("lo")), order=["lo"], sums=["one"],
    ).select("lo", "hi", "y", F.col("one_before").alias("rank"))
    earlier = ranked.select((F.col("rank") + 1).alias("rank"), F.col("hi").alias("prev_hi"), F.col("y").alias("prev_y"))
    later = ranked.select((F.col("rank") - 1).alias("rank"), F.col("lo").alias("next_lo"), F.col("y").alias("next_y"))
    return ranked.join(earlier, "rank", "left").join(later, "rank", "left").drop("rank")


def _line(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return y0 + (y1 - y0) * ((x - x0) / (x1 - x0))


def apply_knots(df: DataFrame, blocks: DataFrame, score: str, name: str) -> DataFrame:
    """Add the calibrated score: a block's value inside it, a line between blocks, flat beyond both ends.

    Null and NaN scores stay null. A score meets the blocks that begin in its
    own fine cell, or else the last one that began in an earlier cell.
    """
    value = F.col(score).cast("double")
    rows = df.withColumns(dict(zip(("_c0", "_c1"), value_cells(value), strict=True)))
    placed = _linked(blocks).withColumns(dict(zip(("_c0", "_c1"), value_cells(F.col("lo")), strict=True)))
    block = F.struct("lo", "hi", "y", "prev_hi", "prev_y", "next_lo", "next_y")
    own = placed.groupBy("_c0", "_c1").agg(F.array_sort(F.collect_list(block)).alias("_own"))
    cells = rows.select("_c0", "_c1").distinct().join(own, ["_c0", "_c1"], "left")
    # Cells with blocks but no scores are carried from, too.
    cells = cells.unionByName(own.join(cells.select("_c0", "_c1"), ["_c0", "_c1"], "left_anti"))
    lookup = running(
        cells.withColumn("_last", F.element_at("_own", -1)), cells=[F.col("_c0"), F.col("_c1")], order=["_c0", "_c1"], lasts=["_last"]
    ).select("_c0", "_c1", "_own", F.col("_last_carried").alias("_last"))
    begun = F.filter("_own", lambda b: b["lo"] <= value)
    met = rows.join(lookup, ["_c0", "_c1"], "left").withColumn(
        "_hit", F.when(F.col("_own").isNull(), F.col("_last")).when(F.size(begun) > 0, F.element_at(begun, -1))
    )
    first = one_row(blocks.agg(F.min_by("calibrated", "lo").alias("y")))
    at, above = F.col("_hit"), F.get("_own", F.lit(0))
    fitted = (
        F.when(value.isNull() | F.isnan(value), F.lit(None).cast("double"))
        .when(at.isNotNull() & ((value <= at["hi"]) | at["next_lo"].isNull()), at["y"])
        .when(at.isNotNull(), _line(value, at["hi"], at["y"], at["next_lo"], at["next_y"]))
        # Below the first block that begins in its cell.
        .when(above["prev_hi"].isNotNull() & (value <= above["prev_hi"]), above["prev_y"])
        .when(above["prev_hi"].isNotNull(), _line(value, above["prev_hi"], above["prev_y"], above["lo"], above["y"]))
        .otherwise(F.col("_first")["y"])
    )
    out = met.withColumn("_first", first).withColumn(name, fitted)
    return out.drop("_c0", "_c1", "_own", "_last", "_hit", "_first")


def interpolate(score: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear value between fixed knots, clipped at both ends."""
    (x0, y0), *rest = points
    value = F.when(score <= x0, F.lit(y0))
    for x1, y1 in rest:
        step = F.lit(y0) + (score - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        value = value.when(score <= x1, step)
        x0, y0 = x1, y1
    return value.when(score > x0, F.lit(y0))
