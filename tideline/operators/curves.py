"""Exact score curves and the metrics read off them.

Rows are first collapsed to distinct scores with their positive and negative
counts (summed before the shuffle, so a score shared by a third of the rows is
one row afterwards). Running counts over those, highest score first, serve
every metric; ties therefore form one cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import ratio, round_dp
from tideline.operators.prefix import attach_totals, running, value_cells


#: Rows of a coarse cell that are ordered in one piece.
FEW_ROWS = 100_000


def cell_levels(df: DataFrame, score: str, groups: Sequence[str] = ()) -> int:
    """How many levels of cells ``score_cuts`` needs: one if no coarse cell of a group holds many rows, or else two.

    One count of the rows; the second level makes a row of totals for nearly every distinct score.
    """
    coarse, _ = value_cells(-F.col(score))
    cells = df.groupBy(*groups, coarse.alias("_c")).agg(F.count(score).alias("_n"))
    most = cells.agg(F.max("_n")).first()[0]
    return 1 if (most or 0) <= FEW_ROWS else 2


def score_cuts(df: DataFrame, score: str, label: str, groups: Sequence[str] = (), *, levels: int = 2) -> DataFrame:
    """Distinct scores with pos, neg and the counts of both at higher scores.

    ``levels`` is that of ``cell_levels``; two hold for any scores.

    Null scores are left out by a count, not by a filter on the score: that
    filter would be pushed below the projection that computes the score and
    compute it twice.
    """
    counted = (
        df.groupBy(*groups, F.col(score).alias("score"))
        .agg(F.sum(label).cast("long").alias("pos"), F.count(score).alias("_n"))
        .where(F.col("_n") > 0)
        .withColumn("neg", F.col("_n") - F.col("pos"))
        .drop("_n")
        .withColumn("_down", -F.col("score"))
    )
    return running(
        counted,
        groups=groups,
        cells=value_cells(F.col("_down"))[:levels],
        order=["_down"],
        sums=["pos", "neg"],
    ).drop("_down")


def _auc() -> Column:
    """Positives above each negative, ties counting half, over P * N."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.sum(neg * (F.col("pos_before") + pos / 2))
    return ratio(above, F.sum(pos) * F.sum(neg))


def _pr_area() -> Column:
    """Trapezoids between neighbouring cuts, from (recall 0, precision 1)."""
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    seen = F.col("pos_before") + F.col("neg_before")
    here = tp / (tp + fp)
    last = F.when(seen > 0, F.col("pos_before") / seen).otherwise(1.0)
    return ratio(F.sum(F.col("pos") * (here + last) / 2), F.sum("pos"))


def _at_threshold(threshold: float) -> dict[str, Column]:
    over = F.col("score") >= threshold
    tp = F.coalesce(F.sum(F.when(over, F.col("pos"))), F.lit(0))
    fp = F.coalesce(F.sum(F.when(over, F.col("neg"))), F.lit(0))
    p, n = F.sum("pos"), F.sum("neg")
    return {
        "f1": F.coalesce(ratio(2 * tp, tp + fp + p), F.lit(0.0)),
        "accuracy": ratio(tp + n - fp, p + n),
    }


def curve_metrics(
    df: DataFrame,
    score: str,
    label: str,
    groups: Sequence[str] = (),
    *,
    threshold: float = 0.5,
    digits: int = 6,
    levels: int = 2,
) -> DataFrame:
    """ROC area, PR area, its shifted form, and F1/accuracy at a threshold.

    ``pr_area_shifted`` is the PR area minus the prevalence, the number that
    integrating recall over precision gives.
    """
    area = _pr_area()
    values = {
        "roc_auc": _auc(),
        "pr_area": area,
        "pr_area_shifted": area - ratio(F.sum("pos"), F.sum(F.col("pos") + F.col("neg"))),
        **_at_threshold(threshold),
    }
    return (
        score_cuts(df, score, label, groups, levels=levels)
        .groupBy(*groups)
        .agg(
            F.sum(F.col("pos") + F.col("neg")).alias("n"),
            *[round_dp(c, digits).alias(name) for name, c in values.items()],
        )
    )


def pr_f1_curve(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at every distinct score."""
    cuts = score_cuts(df, score, label, groups)
    scored = F.when(F.col(score).isNotNull(), F.col(label))
    totals = df.groupBy(*groups).agg(F.coalesce(F.sum(scored), F.lit(0)).alias("_p"))
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    precision = tp.cast("double") / (tp + fp)
    recall = tp.cast("double") / F.greatest(F.col("_p"), F.lit(1))
    both = F.col("precision") + F.col("recall")
    return (
        attach_totals(cuts, totals, groups)
        .select(
            *groups,
            "score",
            tp.alias("tp"),
            fp.alias("fp"),
            precision.alias("precision"),
            recall.alias("recall"),
        )
        .withColumn(
            "f1",
            F.when(both > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / both).otherwise(0.0),
        )
    )


def operating_points(
    df: DataFrame,
    score: str,
    label: str,
    groups: Sequence[str] = (),
    *,
    precision_floor: float = V.PRECISION_FLOOR,
) -> DataFrame:
    """Best cut per group among those that keep the precision floor.

    Highest F1, then precision, then score; both orders sit in one number, as
    ``f1 * 1e6 + precision``. A group whose curve never reaches the floor has
    no row.
    """
    curve = pr_f1_curve(df, score, label, groups)
    merit = F.struct(F.col("f1") * 1_000_000 + F.col("precision"), F.col("score"))
    best = (
        curve.where((F.col("precision") >= precision_floor) & (F.col("recall") > 0))
        .groupBy(*groups)
        .agg(
            F.max_by(
                F.struct(F.col("score").alias("threshold"), "f1", "precision", "recall"), merit
            ).alias("_best")
        )
        .where(F.col("_best").isNotNull())
    )
    return best.select(*groups, "_best.*")


def select_operating_point(
    df: DataFrame, score: str, label: str, *, precision_floor: float = V.PRECISION_FLOOR
) -> Row:
    """The single operating point; an unattainable floor is an error."""
    point = operating_points(df, score, label, precision_floor=precision_floor).first()
    if point is None:
        raise ValueError(f"no threshold reaches a precision of {precision_floor:.2f} (unattainable)")
    return point


def brier(df: DataFrame, scores: Sequence[str], label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean squared distance of each score column from the label, side by side."""
    return df.groupBy(*groups).agg(
        *[
            round_dp(F.avg(F.pow(F.col(s) - F.col(label), F.lit(2.0))), 6).alias(f"brier_{s}")
            for s in scores
        ]
    )


def threshold_metrics(
    df: DataFrame, score: str, label: str, threshold: Column, dims: Sequence[str]
) -> DataFrame:
    """Confusion counts and their ratios for every combination of ``dims``."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    counted = df.cube(*dims).agg(
        F.grouping_id().alias("level"),
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.withColumns(
        {
            "accuracy": round_dp(ratio(tp + tn, tp + fp + fn + tn), 6),
            "precision": round_dp(F.coalesce(ratio(tp, tp + fp), F.lit(0.0)), 6),
            "recall": round_dp(F.coalesce(ratio(tp, tp + fn), F.lit(0.0)), 6),
            "f1": round_dp(F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 6),
        }
    )
