"""Scoring with a linear model, what-if rows, drivers and answers.

A linear model is a handful of numbers, so scores and their reasons are plain
expressions: no join, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import round_dp
from tideline.operators.cleaning import ratio_expr
from tideline.operators.prefix import one_row


@dataclass(frozen=True)
class LinearModel:
    """Coefficients on prepared features and the background they are read against.

    ``numeric``: feature -> (coefficient, fill, mean, std).
    ``categorical``: feature -> {value: (coefficient, share in the background)}.
    """

    intercept: float
    numeric: Mapping[str, tuple[float, float, float, float]] = field(default_factory=dict)
    categorical: Mapping[str, Mapping[str, tuple[float, float]]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def terms(self) -> dict[str, Column]:
        """Additive part of every raw feature; an unseen category adds nothing."""
        out = {}
        for c, (weight, fill, mean, std) in self.numeric.items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(fill))
            out[c] = F.lit(weight) * ((x - F.lit(mean)) / F.lit(std))
        for c, values in self.categorical.items():
            value = None
            for category, (weight, _) in values.items():
                here = F.col(c).cast("string") == category
                value = F.when(here, F.lit(weight)) if value is None else value.when(here, F.lit(weight))
            out[c] = F.lit(0.0) if value is None else value.otherwise(F.lit(0.0))
        return out

    def expected(self) -> dict[str, float]:
        """Mean of every term over the background (scaled numbers average zero)."""
        return {c: 0.0 for c in self.numeric} | {
            c: sum(w * share for w, share in values.values())
            for c, values in self.categorical.items()
        }

    def margin(self) -> Column:
        return reduce(lambda a, b: a + b, self.terms().values(), F.lit(self.intercept))

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def contributions(self) -> dict[str, Column]:
        expected = self.expected()
        return {c: term - F.lit(expected[c]) for c, term in self.terms().items()}


def score(df: DataFrame, model: LinearModel, name: str = "score") -> DataFrame:
    """Raw probability per row."""
    return df.withColumn(name, model.probability())


def label_at_threshold(probability: Column, threshold: Column) -> Column:
    churner, other = V.LABELS
    return F.when(probability >= threshold, churner).otherwise(other)


def top_drivers(contributions: Mapping[str, Column], k: int = 3) -> Column:
    """The k features with the largest absolute contribution, signed.

    Ties keep the declared feature order. Sorting a short array inside the row
    needs no shuffle however many rows there are.
    """
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(
                    (-F.abs(c)).alias("size"),
                    F.lit(i).alias("place"),
                    F.lit(name).alias("feature"),
                    c.alias("contribution"),
                )
                for i, (name, c) in enumerate(contributions.items())
            ]
        )
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda d: F.struct(d["feature"].alias("feature"), d["contribution"].alias("contribution")),
    )


def raw_feature(name: Column, raw_columns: Sequence[str]) -> Column:
    """Raw column of a prepared name: the longest column it starts with."""
    body = F.regexp_replace(name, "^.*?__", "")
    found = None
    for column in sorted(raw_columns, key=len, reverse=True):
        here = (body == column) | body.startswith(column + "_")
        found = F.when(here, column) if found is None else found.when(here, column)
    return found.otherwise(body)


def fold_to_raw(
    contributions: DataFrame, key: str, raw_columns: Sequence[str]
) -> DataFrame:
    """Sum (key, name, contribution) rows over the prepared names of a raw column."""
    return (
        contributions.groupBy(key, raw_feature(F.col("name"), raw_columns).alias("feature"))
        .agg(F.sum("contribution").alias("contribution"))
    )


def what_if(
    scenarios: DataFrame, facts: str, baseline: DataFrame, types: Mapping[str, str]
) -> DataFrame:
    """Baseline row overridden by each scenario's facts, ratio recomputed.

    The baseline is one row, read as a scalar subquery; the flag fact is Yes
    or No, numbers are text.
    """
    base = F.col("_baseline")

    def override(c: str) -> Column:
        fact = F.col(facts)[c]
        if c in V.NUMERIC_FEATURES:
            return F.coalesce(fact.cast("double"), base[c].cast("double"))
        if c == V.FLAG:
            return F.coalesce(fact == V.POSITIVE, base[c].cast("boolean"))
        return F.coalesce(fact, base[c].cast(types.get(c, "string")))

    return (
        scenarios.withColumn("_baseline", one_row(baseline.select(*V.FEATURES)))
        .withColumns({c: override(c) for c in V.FEATURES})
        .withColumn(V.RATIO, ratio_expr(F.col("Total_Charges"), F.col("tenure")))
        .drop("_baseline")
    )


def fixed4(value: Column) -> Column:
    """Four decimals as text."""
    return F.format_string("%.4f", round_dp(value, 4))


def short4(value: Column) -> Column:
    """Four decimals as text without trailing zeros, one decimal at least."""
    return F.regexp_replace(fixed4(value), r"(\.\d+?)0+$", "$1")


def compose_answer(
    probability: Column, label: Column, threshold: Column, facts: Column, drivers: Column
) -> Column:
    """The fixed answer sentence; every number in it comes from the row."""
    stated = F.transform(
        F.array_sort(F.map_entries(facts)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    reasons = F.transform(
        drivers,
        lambda d: F.concat(d["feature"], F.lit(" weight "), short4(d["contribution"])),
    )
    profile = F.when(F.size(stated) > 0, F.array_join(stated, ", ")).otherwise(V.REPLY_BASELINE)
    return F.format_string(
        V.REPLY_ANSWER,
        fixed4(probability),
        label,
        fixed4(threshold),
        profile,
        F.array_join(reasons, "; "),
    )


def sensitivity_report(
    df: DataFrame, model: LinearModel, scenarios: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Mean score and label rate per noise scenario, each a factor per column.

    The rows are labelled synthetic: this is no validation.
    """
    variants = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                *[F.lit(float(factors.get(c, 1.0))).alias(f"_x_{c}") for c in model.numeric],
            )
            for name, factors in scenarios.items()
        ]
    )
    varied = df.select("*", F.inline(variants))
    scaled = varied.withColumns(
        {c: F.col(c).cast("double") * F.col(f"_x_{c}") for c in model.numeric}
    )
    return (
        score(scaled, model)
        .groupBy("scenario")
        .agg(
            F.count("*").alias("n"),
            round_dp(F.avg("score"), 6).alias("mean_score"),
            round_dp(F.avg("label"), 6).alias("label_rate"),
        )
        .withColumn("synthetic", F.lit(True))
    )
