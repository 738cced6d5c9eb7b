"""Exact quantiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.prefix import group_key, running, value_cells


def _counted_near(
    df: DataFrame, value: str, groups: Sequence[str], indexes: Sequence[Column]
) -> DataFrame:
    """Distinct values with their count, the count below, and the group size,
    for the cells alone that hold one of the wanted indexes.

    The first pass counts rows per coarse cell, so a few thousand counts per
    group are shuffled. Only the values of the cells found, about one in a
    thousand, are shuffled and sorted in the second. Whether the wanted cells,
    one or two per group and index, are broadcast is left to their size.
    """
    groups = list(groups)
    coarse, fine = value_cells(F.col(value))
    known = (
        df.where(F.col(value).isNotNull())
        .select(*groups, F.col(value).cast("double").alias(value))
        .withColumn("_c", coarse)
    )
    cells = known.groupBy(*groups, "_c").agg(F.count("*").alias("_cell_n"))
    # a double has 2,100 exponents of 1,024 cells, so a group's cells are few
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    upto = whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumns(
        {
            "_size": F.sum("_cell_n").over(whole),
            "_skip": F.sum("_cell_n").over(upto) - F.col("_cell_n"),
        }
    )
    holds = F.lit(False)
    for index in indexes:
        holds = holds | ((F.col("_skip") <= index) & (index < F.col("_skip") + F.col("_cell_n")))
    wanted = placed.where(holds).select(
        group_key([*groups, "_c"]).alias("_cell"), "_size", "_skip"
    )
    distinct = (
        known.withColumn("_cell", group_key([*groups, "_c"]))
        .join(wanted, "_cell")
        .groupBy(*groups, "_c", "_size", "_skip", value)
        .agg(F.count("*").alias("_n"))
    )
    inside = running(distinct, groups=[*groups, "_c"], cells=[fine], order=[value], sums=["_n"])
    return inside.withColumn("_n_before", F.col("_n_before") + F.col("_skip"))


def _at(value: str, index: Column) -> Column:
    inside = (F.col("_n_before") <= index) & (index < F.col("_n_before") + F.col("_n"))
    return F.max(F.when(inside, F.col(value)))


def nearest_rank(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
) -> DataFrame:
    """The sorted value at index min(round_half_even(q * (n - 1)), n - 1)."""
    last = F.col("_size") - 1
    index = {
        name: F.least(F.bround(F.lit(q) * last, 0).cast("long"), last) for name, q in probs.items()
    }
    counted = _counted_near(df, value, groups, list(index.values()))
    return counted.groupBy(*groups).agg(
        F.max("_size").alias("samples"), *[_at(value, i).alias(n) for n, i in index.items()]
    )


def interpolated(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Linear interpolation between the two neighbouring sorted values."""
    position = {name: F.lit(q) * (F.col("_size") - 1) for name, q in probs.items()}
    picks, indexes = [], []
    for name, at in position.items():
        low, high = F.floor(at), F.ceil(at)
        indexes += [low, high]
        picks += [
            _at(value, low).alias(f"_{name}_low"),
            _at(value, high).alias(f"_{name}_high"),
            F.max(at - low).alias(f"_{name}_part"),
        ]
    counted = _counted_near(df, value, groups, indexes)
    return counted.groupBy(*groups).agg(*picks).select(
        *groups,
        *[
            (
                F.col(f"_{n}_low")
                + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")
            ).alias(n)
            for n in probs
        ],
    )


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], kind: str) -> DataFrame:
    """Long form (keys, feature, value): one pass for all columns."""
    return df.unpivot(
        list(keys), [F.col(c).cast(kind).alias(c) for c in columns], "feature", "value"
    )


def medians(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, feature) with the exact median, nulls ignored.

    """
    long = unpivot(df, groups, columns, "double")
    return interpolated(
        long, "value", {"median": 0.5}, [*groups, "feature"]
    )


def fold_medians(known: DataFrame, counts: DataFrame, fold: str, fine: Column) -> DataFrame:
    """(trains, feature, median) over the rows outside each fold.

    ``known`` has fold, feature, value and its coarse cell ``_c``; ``counts``
    has the training side's rows by (trains, feature, _c). Only values in a
    cell that holds a median are read, once for all folds that want them.
    """
    whole = Window.partitionBy("trains", "feature")
    upto = whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns(
        {"_size": F.sum("n").over(whole), "_skip": F.sum("n").over(upto) - F.col("n")}
    )
    low = F.floor((F.col("_size") - 1) / 2)
    high = F.ceil((F.col("_size") - 1) / 2)
    holds = lambda at: (F.col("_skip") <= at) & (at < F.col("_skip") + F.col("n"))
    wanted = placed.where(holds(low) | holds(high)).select("trains", "feature", "_c", "_size", "_skip")
    cells = wanted.select("feature", "_c").distinct()
    values = known.join(cells, ["feature", "_c"]).groupBy("feature", "_c", fold, "value").agg(F.count("*").alias("_n"))
    outside = (
        values.join(wanted, ["feature", "_c"])
        .where(F.col("trains") != F.col(fold))
        .groupBy("trains", "feature", "_c", "_size", "_skip", "value").agg(F.sum("_n").alias("_n"))
    )
    inside = running(outside, groups=["trains", "feature", "_c"], cells=[fine], order=["value"], sums=["_n"])
    counted = inside.withColumn("_n_before", F.col("_n_before") + F.col("_skip"))
    below, above, between = _at("value", low), _at("value", high), F.max((F.col("_size") - 1) / 2 - low)
    return counted.groupBy("trains", "feature").agg((below + (above - below) * between).alias("median"))
