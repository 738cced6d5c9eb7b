"""Packs: runs of documents written as one row each, so later passes meet the same runs.

A pack holds about two megabytes of text. It is made where its documents are
read, without a shuffle, and kept in the shared folder; its number is fixed
once the file is committed. Work that compares windows across documents sends
packed arrays from packs to buckets of hash values and answers back to packs,
a few rows a pack instead of one row a window. Packs are dealt out evenly
whatever the ids, sources or copies are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tideline.llm.tables import text_of
from tideline.llm.words import packs, text_bytes
from tideline.session import scratch_path

PACK_TEXT = 2 << 20


_CODEC = "zstd"


def _pack(limit: int, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in packs(offsets, limit):
                size = np.array([0, hi - lo], np.int32)
                body = data[offsets[lo] : offsets[hi]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(size), ids.slice(lo, hi - lo).cast(doc_type)),
                        pa.ListArray.from_arrays(pa.array(size), pa.array(offsets[lo + 1 : hi + 1] - offsets[lo])),
                        pa.array([len(body)], pa.int64()),
                        pa.array([pa.compress(body.tobytes(), codec=_CODEC, asbytes=True)], pa.binary()),
                    ],
                    names=["pack", "doc_ids", "ends", "n_bytes", "body"],
                )
                number += 1

    return run


def write_packs(docs: DataFrame, limit: int = PACK_TEXT) -> DataFrame:
    """The documents as packs in the shared folder; null text becomes empty.

    A pack has its number, the documents' ids, where their texts end, the
    number of bytes, and the bytes themselves, compressed.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        _pack(limit, to_arrow_type(kind)),
        f"pack long, doc_ids array<{kind.simpleString()}>, ends array<long>, n_bytes long, body binary",
    )
    path = scratch_path(docs.sparkSession, "packs")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def unpack(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Each pack's number, ids, bytes, and offsets of its texts."""
    for k in range(table.num_rows):
        offsets = np.concatenate([[0], table.column("ends")[k].values.to_numpy()])
        data = np.zeros(0, np.uint8)
        if offsets[-1]:
            body = table.column("body")[k].as_buffer()
            data = np.frombuffer(pa.decompress(body, decompressed_size=int(offsets[-1]), codec=_CODEC), np.uint8)
        yield table.column("pack")[k].as_py(), table.column("doc_ids")[k].values, data, offsets
