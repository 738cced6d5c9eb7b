"""Sliding-log call budgets.

A call is admitted if fewer than ``max_calls`` admitted calls of its key lie
within the window before it; refused calls leave no trace. That last clause
makes the log sequential, so a range window cannot express it. But a pause
longer than the window clears it: between pauses a key falls into pieces that
do not depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.prefix import group_key

DETAIL = ("key", "ts_us", "event_id")


class AdmittedRing:
    """The last ``size`` admitted times, the oldest at the cursor.

    The oldest of them alone decides: while it lies inside the window, all of
    them do.
    """

    def __init__(self, size: int, window_us: int, times: list[int] | None = None):
        self.window_us = window_us
        self.slots: list[int | None] = [None] * size
        self.cursor = 0
        for t in times or ():
            self._store(t)

    def _store(self, t: int) -> None:
        self.slots[self.cursor] = t
        self.cursor = (self.cursor + 1) % len(self.slots)

    def offer(self, t: int) -> bool:
        if not self.slots:
            return False
        oldest = self.slots[self.cursor]
        if oldest is not None and t - oldest <= self.window_us:
            return False
        self._store(t)
        return True

    def times(self) -> list[int]:
        """Admitted times from old to new."""
        turned = self.slots[self.cursor :] + self.slots[: self.cursor]
        return [t for t in turned if t is not None]


def _fold(max_calls: int, window_us: int):
    """A batch function over rows sorted by (key, piece, ts_us, event_id).

    Batches stream through; only the ring of the current piece is held. The
    head of a piece shorter than the ring is admitted without a look.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ring = None, AdmittedRing(max_calls, window_us)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column("key").dictionary_encode(null_encoding="encode").indices
            code = codes.to_numpy(zero_copy_only=False)
            piece = batch.column("piece").to_numpy()
            times = batch.column("ts_us").to_numpy()
            fresh = np.ones(n, np.bool_)
            fresh[1:] = (code[1:] != code[:-1]) | (piece[1:] != piece[:-1])
            fresh[0] = last != (batch.column("key")[0].as_py(), int(piece[0]))
            start = np.flatnonzero(np.concatenate([[True], fresh[1:]]))
            end = np.append(start[1:], n)
            flags = np.ones(n, np.bool_)
            whole = fresh[start] & (end - start <= max_calls)
            whole[-1] = False  # the next batch may go on with it
            for lo, hi in zip(start[~whole].tolist(), end[~whole].tolist(), strict=True):
                if fresh[lo]:
                    ring = AdmittedRing(max_calls, window_us)
                flags[lo:hi] = [ring.offer(t) for t in times[lo:hi].tolist()]
            last = (batch.column("key")[n - 1].as_py(), int(piece[-1]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in DETAIL), pa.array(flags)], names=[*DETAIL, "admitted"]
            )

    return run


def call_budget(calls: DataFrame, *, max_calls: int, window_us: int) -> DataFrame:
    """Add ``admitted`` to calls (key, ts_us, event_id).

    Time is cut into cells longer than the window. A cell without a call of a
    key is a pause that clears the key's log, so runs of neighbouring cells are
    independent pieces, and each streams through one task. Only (key, cell)
    pairs are looked at to find the runs, never the calls of a key together; a
    null key is a key like any other.
    """
    kinds = dict(calls.dtypes)
    cell = F.shiftright("ts_us", int(window_us).bit_length())
    rows = calls.select(*DETAIL).withColumns({"_key": group_key(["key"]), "_cell": cell})
    ordered = Window.partitionBy("_key").orderBy("_cell")
    before = F.lag("_cell").over(ordered)
    opens = F.when(before.isNull() | (F.col("_cell") - before > 1), F.col("_cell"))
    pieces = (
        rows.select("_key", "_cell").distinct()
        .withColumn("_opens", opens)
        .select("_key", "_cell", F.last("_opens", ignorenulls=True).over(ordered).alias("piece"))
    )
    placed = rows.join(pieces, ["_key", "_cell"]).select(*DETAIL, "piece")
    sorted_calls = placed.repartition("key", "piece").sortWithinPartitions(
        "key", "piece", "ts_us", "event_id"
    )
    schema = f"key {kinds['key']}, ts_us bigint, event_id {kinds['event_id']}, admitted boolean"
    return sorted_calls.mapInArrow(_fold(max_calls, window_us), schema)


def budget_report(budget: DataFrame, window_us: int) -> DataFrame:
    """Refused calls with their code and the seconds to wait: the whole window."""
    return budget.where(~F.col("admitted")).select(
        *DETAIL,
        F.lit("rate_limited").alias("code"),
        F.lit(window_us // 1_000_000).cast("long").alias("retry_after"),
    )


def budget_by_key(budget: DataFrame) -> DataFrame:
    """Admitted and refused calls per key."""
    return budget.groupBy("key").agg(
        F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused")
    )
