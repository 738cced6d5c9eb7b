"""Connected components of an edge table, without bringing edges or nodes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialize


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that edges (a, b) connect it with."""
    parent = np.arange(n)
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return parent
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component: the same components, fewer edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = labels(len(nodes), index[: len(a)], index[len(a) :])
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connect(edges: DataFrame) -> DataFrame:
    """node, label of every node that has an edge; equal labels mean connected.

    Edges come thinned by whoever makes them, as far as that is cheap there: in
    that stage a second Python worker would stand beside the one that makes
    them. They are thinned to a forest inside each partition once they are
    written. Then, round by round, every node is merged into the neighbour with the least hash, if that
    is below its own, and edges are drawn again between what is left, until
    none is. The hash changes every round, so whatever the nodes are called a
    fixed share of them is expected to merge, and edges fall off
    geometrically. A node with very many edges is only a key of a
    pre-aggregated minimum and of a join that can be split.
    """
    # Edges and nodes are far smaller than what they came from: fewer, fuller partitions.
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)

    def thinned(drawn: DataFrame) -> DataFrame:
        return materialize(drawn.coalesce(parts).mapInArrow(_local_forest, "a long, b long"), "edges")

    # Making the edges is the work, so that step keeps its own parallelism.
    made = materialize(edges.select("a", "b"), "edges")
    left = thinned(made)
    out = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    step = 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = F.min(F.struct(F.xxhash64("b", F.lit(step)).alias("hash"), F.col("b").alias("node")))
        own = F.struct(F.xxhash64("from", F.lit(step)).alias("hash"), F.col("from").alias("node"))
        parent = materialize(
            both.groupBy(F.col("a").alias("from")).agg(near.alias("near"))
            .select("from", F.least("near", own)["node"].alias("to")).coalesce(parts),
            "parents",
        )
        out = materialize(
            out.join(parent, out["label"] == parent["from"], "left").select(
                "node", F.coalesce("to", "label").alias("label")
            ).coalesce(parts),
            "components",
        )
        first = parent.select(F.col("from").alias("a"), F.col("to").alias("x"))
        second = parent.select(F.col("from").alias("b"), F.col("to").alias("y"))
        drawn = left.join(first, "a").join(second, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        left = thinned(drawn)
        step += 1
    return out if step else materialize(out, "components")
