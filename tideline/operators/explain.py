"""Reasons for the scores of tree models.

Each tree adds, for every split on the way to the leaf, the change of the node
value to the feature that was split on. The parts and the root values sum to
the margin of the row exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.boosting import LeafwiseModel
from tideline.session import scratch_path


@dataclass(frozen=True)
class Trees:
    """Node arrays of all trees; child -1 marks a leaf."""

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float = 0.0

    @property
    def base(self) -> float:
        return float(self.start + np.sum(self.weights * self.value[self.roots]))


def read_trees(spark: SparkSession, model) -> Trees:
    """The trees of a fitted model, from its own saved form.

    The node count is set by the tree parameters, not by the data.
    """
    if isinstance(model, LeafwiseModel):
        return _leafwise_trees(model)
    path = scratch_path(spark, "trees")
    model.write().save(path)
    n = F.col("nodeData")
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            n["id"].alias("id"),
            n["prediction"].alias("prediction"),
            n["impurityStats"].alias("stats"),
            n["leftChild"].alias("left"),
            n["rightChild"].alias("right"),
            n["split"]["featureIndex"].alias("feature"),
            F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        )
        .toPandas()
        .sort_values(["treeID", "id"], ignore_index=True)
    )
    if isinstance(model, GBTClassificationModel):
        value = nodes["prediction"].to_numpy(float)
        # twice the boosted sum is the log-odds
        weights = 2.0 * np.asarray(model.treeWeights, dtype=float)
    elif isinstance(model, RandomForestClassificationModel):
        value = np.array([s[1] / sum(s) for s in nodes["stats"]], dtype=float)
        weights = np.full(len(model.treeWeights), 1.0 / len(model.treeWeights))
    else:
        raise TypeError(f"{type(model).__name__} is no tree model")
    first = nodes.groupby("treeID").head(1)
    start = nodes["treeID"].map(dict(zip(first["treeID"], first.index))).to_numpy()
    left, right = nodes["left"].to_numpy(), nodes["right"].to_numpy()
    return Trees(
        roots=first.index.to_numpy(),
        weights=weights,
        feature=nodes["feature"].to_numpy(int),
        threshold=nodes["threshold"].fillna(0.0).to_numpy(float),
        left=np.where(left >= 0, left + start, -1),
        right=np.where(left >= 0, right + start, -1),
        value=value,
    )


def _leafwise_trees(model: LeafwiseModel) -> Trees:
    arrays = model.arrays()
    start = np.cumsum([0, *(len(a[0]) for a in arrays)])
    joined = [np.concatenate([a[c] for a in arrays]) if arrays else np.zeros(0) for c in range(5)]
    shift = np.repeat(start[:-1], np.diff(start))
    left, right = (np.where(joined[c] >= 0, joined[c] + shift, -1).astype(int) for c in (2, 3))
    return Trees(
        start[:-1], np.ones(len(arrays)), joined[0].astype(int), joined[1].astype(float), left, right, joined[4].astype(float),
        model.getOrDefault("base"),
    )


def attribute(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Contribution of every prepared column, for a batch of rows."""
    out = np.zeros(x.shape)
    row = np.arange(len(x))
    for root, weight in zip(trees.roots, trees.weights):
        at = np.full(len(x), root)
        going = trees.left[at] >= 0
        while going.any():
            r, node = row[going], at[going]
            split = trees.feature[node]
            child = np.where(
                x[r, split] <= trees.threshold[node], trees.left[node], trees.right[node]
            )
            out[r, split] += weight * (trees.value[child] - trees.value[node])
            at[going] = child
            going = trees.left[at] >= 0
    return out


def tree_drivers(
    scored: DataFrame,
    key: str,
    model,
    raw_names: Sequence[str],
    *,
    k: int = 3,
    features: str = "features",
) -> DataFrame:
    """(key, margin, drivers) with the k strongest raw columns per row.

    The node arrays travel once per executor as a broadcast variable; rows
    stream through in Arrow batches.
    """
    spark = scored.sparkSession
    order = list(dict.fromkeys(raw_names))
    into = np.zeros((len(raw_names), len(order)))
    for i, name in enumerate(raw_names):
        into[i, order.index(name)] = 1.0
    # plain arrays, as a broadcast value is pickled by reference to its class
    shared = spark.sparkContext.broadcast((asdict(read_trees(spark, model)), into, order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, fold, names = shared.value
        trees = Trees(**arrays)
        for batch in batches:
            if batch.empty:
                continue
            parts = attribute(trees, np.vstack(batch["x"].to_numpy())) @ fold
            top = np.argsort(-np.abs(parts), axis=1, kind="stable")[:, :k]
            yield pd.DataFrame(
                {
                    key: batch[key].to_numpy(),
                    "margin": trees.base + parts.sum(axis=1),
                    "drivers": [
                        [{"feature": names[j], "contribution": float(p[j])} for j in t]
                        for p, t in zip(parts, top)
                    ],
                }
            )

    kind = dict(scored.dtypes)[key]
    rows = scored.select(key, vector_to_array(features).alias("x"))
    return rows.mapInPandas(
        run, f"{key} {kind}, margin double, drivers array<struct<feature string, contribution double>>"
    )
