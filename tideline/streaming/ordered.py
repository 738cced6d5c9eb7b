"""Event-time order for folds that depend on it.

Rows are held per key until the watermark has passed them, then sorted and
folded. So the result does not depend on how rows were spread over batches;
rows behind the watermark are dropped by the engine, which counts them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PIECE_ROWS = 4096  # rows of a key that are held as one piece

_FIRST = T.StructType([T.StructField("first", T.LongType())])
_HELD = T.StructType([T.StructField("rows", T.StringType())])
_CARRY = T.StructType([T.StructField("carry", T.StringType())])


def _timer(ts_us: int) -> int:
    """A timer that fires once the watermark has reached a time: timers fire
    when the watermark is past them, and it counts in milliseconds."""
    return -(-ts_us // 1000) - 1


class OrderedFold(StatefulProcessor):
    """Holds rows (ts_us, event_id, body) and folds them in order.

    Subclasses say how a carry and one row give a new carry and an output.
    The held rows of a key are bounded by the watermark delay, the carry by
    the subclass. What a batch brings for a key is held in pieces, sorted and
    named by their first time, so state is touched once for a piece and not
    once for a row. A batch writes only pieces of its own rows, and a timer
    reads only pieces that have rows due.
    """

    def start(self):
        raise NotImplementedError

    def step(self, carry, ts_us: int, event_id: int, body: str):
        raise NotImplementedError

    def lapses(self, carry) -> int | None:
        """The time after which a row no longer depends on the carry, if there is
        one: the carry is dropped once the watermark has reached it."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getMapState("held", _FIRST, _HELD)
        self._carry = handle.getValueState("carry", _CARRY)

    def _hold(self, rows: list) -> None:
        """Hold rows in pieces, each with a timer at its first row; rows of one time stay together."""
        rows.sort(key=lambda r: r[0])
        start = 0
        while start < len(rows):
            end = min(start + PIECE_ROWS, len(rows))
            while end < len(rows) and rows[end][0] == rows[end - 1][0]:
                end += 1
            piece, first = rows[start:end], rows[start][0]
            if self._held.containsKey((first,)):
                piece = json.loads(self._held.getValue((first,))[0]) + piece
            self._held.updateValue((first,), (json.dumps(piece),))
            self._handle.registerTimer(_timer(first))
            start = end

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added: list = []
        for batch in rows:
            for t, e, b in zip(batch["ts_us"], batch["event_id"], batch["body"]):
                added.append([int(t), None if pd.isna(e) else int(e), b])
        self._hold(added)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for first in [k[0] for k in self._held.keys()]:
            if first > limit:
                continue
            for r in json.loads(self._held.getValue((first,))[0]):
                (due if r[0] <= limit else rest).append(r)
            self._held.removeKey((first,))
        self._hold(rest)
        if not due:
            self._drop_lapsed(limit)
            return
        due.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or ""))
        carry = json.loads(self._carry.get()[0]) if self._carry.exists() else self.start()
        out = []
        for ts_us, event_id, body in due:
            carry, value = self.step(carry, ts_us, event_id, body)
            out.append((key[0], ts_us, event_id, value))
        self._carry.update((json.dumps(carry),))
        self._drop_lapsed(limit)
        yield pd.DataFrame(out, columns=["key", "ts_us", "event_id", "value"])

    def _drop_lapsed(self, limit: int) -> None:
        """Drop the carry if its time is over, or look again when it will be.

        Rows still held or still to come are later than the watermark, so none
        of them needs a carry that lapsed before it.
        """
        if not self._carry.exists():
            return
        lapse = self.lapses(json.loads(self._carry.get()[0]))
        if lapse is None:
            return
        if lapse <= limit:
            self._carry.clear()
        else:
            self._handle.registerTimer(_timer(lapse))

    def close(self) -> None:
        pass


def fold_stream(
    rows: DataFrame, processor: OrderedFold, value_type: T.DataType, *, delay: str
) -> DataFrame:
    """Fold a stream of (key, ts, event_id, body) per key in event-time order."""
    out = T.StructType(
        [
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("ts_us", T.LongType()),
            T.StructField("event_id", T.LongType()),
            T.StructField("value", value_type),
        ]
    )
    return (
        rows.withColumn("ts", F.col("ts").cast("timestamp"))  # zone-less times carry no watermark
        .withWatermark("ts", delay)
        .withColumn("ts_us", F.unix_micros("ts"))
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=out,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
