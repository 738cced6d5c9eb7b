"""Contiguous shards of nearly equal bytes, cut by global prefix sums.

Rows go to ranges of (doc_id, checksum, size); inside each range running sums
are taken in order, and the totals of the ranges, one small row each, give
every range its offset. A row lies in the shard that holds the middle of its
bytes, so a cut falls at the row edge nearest to its target. Only the id, the
size and the checksum are shuffled, never the text.

Defined results: null text has no bytes; null ids come first; rows that agree
in id, size and checksum may take each other's places. An empty table gives no
rows. There are always ``shards`` shards; a shard that lies wholly inside one
long document has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.tables import text_of
from tideline.session import materialize


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows before and bytes before each row of this range."""
    part = TaskContext.get().partitionId()
    rows, before = 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        n = len(size)
        total = np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "size", "text_crc32")),
                pa.array(np.full(n, part, np.int32)),
                pa.array(rows + np.arange(n, dtype=np.int64)),
                pa.array(before + total - size),
            ],
            names=["doc_id", "size", "text_crc32", "part", "local_row", "local_start"],
        )
        rows += n
        before += int(total[-1]) if n else 0


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, place in it and byte offset of every document."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_of("text")) + 1).cast("long").alias("size"),
        F.crc32(text_of("text")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__row"),
    )
    keys = ["doc_id", "text_crc32", "size", "__row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = materialize(
        ordered.mapInArrow(
            _running,
            f"doc_id {kind}, size long, text_crc32 long, part int, local_row long, local_start long",
        ),
        "byte-shards",
    )
    # One row per range: a few bytes for each shuffle partition.
    totals = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    start = F.col("bytes_before") + F.col("local_start")
    sharded = placed.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32",
        start.alias("start"),
        (F.col("rows_before") + F.col("local_row")).alias("row"),
        F.expr(f"cast(((bytes_before + local_start) * 2 + size) * {shards} div (2 * all_bytes) as int)").alias("shard"),
    )
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "start"
    )
