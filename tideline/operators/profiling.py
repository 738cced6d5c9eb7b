"""Profiling reports: one pass over the table each."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import round_dp
from tideline.operators.cleaning import ratio_expr
from tideline.operators.prefix import one_row
from tideline.operators.quantiles import medians, unpivot


def null_profile(df: DataFrame) -> DataFrame:
    """Null count per column: one aggregate row, then turned on its side."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls")


def feature_twins(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows equal on all features: how many, and their label rate."""
    vectors = df.groupBy(*features).agg(
        F.count("*").alias("n"), F.sum(label).alias("positives")
    )
    twin = F.col("n") > 1
    return vectors.agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("unique_vectors"),
        F.coalesce(F.sum(F.when(twin, F.col("n"))), F.lit(0)).alias("rows_with_twin"),
        F.count_if(twin & (F.col("positives") > 0) & (F.col("positives") < F.col("n"))).alias(
            "mixed_label_groups"
        ),
        round_dp(F.sum(F.when(twin, F.col("positives"))) / F.sum(F.when(twin, F.col("n"))), 6).alias(
            "twin_label_rate"
        ),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, in one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("left_column"),
                        F.lit(b).alias("right_column"),
                        round_dp(F.col(f"c{i}"), 6).alias("pearson"),
                    )
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def churn_rate_by(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Label rate per value of every feature, by one unpivoted aggregation."""
    return (
        unpivot(df.select(label, *features), [label], features, "string")
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"), round_dp(F.avg(label), 6).alias("label_rate"))
    )


def churn_rate_cube(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Label rate for every combination of the features and all their totals."""
    return df.cube(*features).agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n"),
        F.sum(label).alias("positives"),
        round_dp(F.avg(label), 6).alias("label_rate"),
    )


def numeric_by_label(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Median and mean of each numeric column per label."""
    means = (
        unpivot(df, [label], columns, "double")
        .groupBy(label, "feature")
        .agg(round_dp(F.avg("value"), 4).alias("mean"))
    )
    middle = medians(df, columns, [label]).withColumn("median", round_dp(F.col("median"), 4))
    return means.join(middle, [label, "feature"])


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column; the smallest value wins a tie."""
    counted = (
        unpivot(df, [], columns, "string")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )
    rarest_last = F.struct(-F.col("n"), F.col("value"))
    return counted.groupBy("feature").agg(F.min_by("value", rarest_last).alias("value"))


def baseline_profile(
    df: DataFrame,
    numeric: Sequence[str] = V.NUMERIC_FEATURES,
    categorical: Sequence[str] = V.CATEGORICAL_FEATURES,
) -> DataFrame:
    """One row: mean of the numeric columns, mode of the others, ratio recomputed."""
    means = df.agg(*[round_dp(F.avg(F.col(c).cast("double")), 6).alias(c) for c in numeric])
    modal = modes(df, categorical).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in categorical]
    )
    types = dict(df.dtypes)
    return (
        means.withColumn("_modes", one_row(modal))
        .withColumns(
            {c: F.col("_modes")[c].cast(types[c]) for c in categorical}
            | {V.RATIO: ratio_expr(F.col("Total_Charges"), F.col("tenure"))}
        )
        .drop("_modes")
    )
