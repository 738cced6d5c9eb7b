"""Running a stream over the files that are there, into a Parquet sink."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tideline.session import scratch_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(
    spark: SparkSession,
    folder: str,
    schema,
    *,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the Parquet files of a folder, with a stated schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


class Closing:
    """A second input of a stream that ends it.

    Rows wait for a watermark that only newer rows move. When the input is
    known to have ended, one row of a far future time lets the watermark pass
    everything held; that row itself, of plain values, is never passed. Its
    columns must be numbers, text and flags.
    """

    def __init__(self, spark: SparkSession, schema):
        self.schema = schema
        self.folder = scratch_path(spark, "closing")
        spark.createDataFrame([], schema).write.parquet(self.folder)

    def added_to(self, stream: DataFrame) -> DataFrame:
        """The stream with the closing input; call it before the watermark is set."""
        closing = stream.sparkSession.readStream.schema(self.schema).parquet(self.folder)
        return stream.unionByName(closing.select(*stream.columns))

    def close(self, spark: SparkSession, time_column: str) -> None:
        far = datetime.datetime(2200, 1, 1)  # nanoseconds end in 2262
        plain = {"string": "", "double": 0.0, "float": 0.0, "boolean": False}
        row = [
            far if f.name == time_column else plain.get(f.dataType.simpleString(), 0)
            for f in self.schema
        ]
        spark.createDataFrame([row], self.schema).write.mode("append").parquet(self.folder)


@dataclass
class Report:
    """What the batches of a stream say of its state, by (run, batch)."""

    _batches: dict = field(default_factory=dict)

    def add(self, running: StreamingQuery) -> None:
        """Note the batches a query still remembers; call it often, as Spark
        forgets all but the last hundred."""
        for progress in running.recentProgress:
            states = progress["stateOperators"]
            self._batches[(progress["runId"], progress["batchId"])] = (
                sum(s["numRowsDroppedByWatermark"] for s in states),
                sum(s["numRowsTotal"] for s in states),
            )

    @property
    def late_rows(self) -> int:
        """Rows dropped behind the watermark. A batch done again after a failure
        belongs to another run and counts again."""
        return sum(late for late, _ in self._batches.values())

    @property
    def state_rows(self) -> int:
        """Rows of state after the last batch."""
        return list(self._batches.values())[-1][1] if self._batches else 0


def run_available(
    stream: DataFrame,
    name: str,
    *,
    arrivals: Sequence[Callable[[], None]] = (),
    closing: Closing | None = None,
    time_column: str = "ts",
    report: Report | None = None,
) -> DataFrame:
    """Process all available files with a checkpoint and return the sink's rows.

    Sink and checkpoint lie in the shared folder; a restarted query goes on
    from its checkpoint and writes each row once. After each of ``arrivals``,
    which bring new files, the query is started again. With ``closing`` it is
    started once more in the end, and the rows still held are folded too.
    A ``report`` is told how many rows came too late.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    path = scratch_path(spark, name)

    def run() -> None:
        running = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        if report is None:
            running.awaitTermination()
            return
        try:
            while not running.awaitTermination(1):
                report.add(running)
        finally:
            report.add(running)

    try:
        run()
        for arrive in arrivals:
            arrive()
            run()
        if closing is not None:
            closing.close(spark, time_column)
            run()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
