"""Seeded, exact, stratified partitioning by hash order of a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import hash60, round_dp
from tideline.operators.prefix import hash_cells, integer_cells, running


def _seed(seed: int | Column) -> Column:
    return seed if isinstance(seed, Column) else F.lit(seed)


def test_quota(counts: DataFrame, by: Sequence[str], label: str, share: float) -> DataFrame:
    """Test rows per label: ceil(share * n) shared out by largest remainder."""
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    spread = (
        counts.withColumn("_rows", F.sum("_n").over(whole))
        .withColumn("_test", F.ceil(round_dp(F.lit(share) * F.col("_rows"), 6)))
        # integer arithmetic, so no remainder depends on rounding
        .withColumn("_floor", F.expr("(_test * _n) div _rows"))
        .withColumn("_rest", F.expr("(_test * _n) % _rows"))
    )
    by_rest = whole.orderBy(F.desc("_rest"), F.asc(label))
    spare = F.col("_test") - F.sum("_floor").over(whole)
    return spread.withColumn(
        "quota",
        F.col("_floor") + (F.row_number().over(by_rest) <= spare).cast("long"),
    ).select(*by, label, "quota")


def stratified_split(
    df: DataFrame,
    *,
    key: str,
    label: str,
    seed: int | Column,
    test_share: float = V.TEST_SHARE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``part`` ('train' or 'test'); exact sizes, label share kept in both.

    Two label values would make two huge tasks of a ranking window. Instead
    the rows are counted per hash cell, the cell holding the cut is found per
    label, and only that cell's rows are ranked. What comes back is one cut
    point per label, against which every row is compared in place.
    """
    by = list(by)
    strata = [*by, label]
    hashed = df.withColumn("_h", hash60(_seed(seed), F.col(key)))
    coarse, fine = hash_cells(F.col("_h"))
    cells = (
        hashed.groupBy(*strata, coarse.alias("_c"), fine.alias("_f"))
        .agg(F.count("*").alias("_n"))
    )
    counts = cells.groupBy(*strata).agg(F.sum("_n").alias("_n"))
    quota = test_quota(counts, by, label, test_share)
    placed = running(
        cells, groups=strata, cells=[F.col("_c")], order=["_f"], sums=["_n"]
    ).join(quota, strata)
    cut_cell = placed.where(
        (F.col("_n_before") < F.col("quota"))
        & (F.col("quota") <= F.col("_n_before") + F.col("_n"))
    ).select(*strata, "_c", "_f", (F.col("quota") - F.col("_n_before")).alias("_take"))
    inside = hashed.select(*strata, key, "_h", coarse.alias("_c"), fine.alias("_f")).join(
        F.broadcast(cut_cell), [*strata, "_c", "_f"]  # one row per stratum
    )
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))
    cuts = (
        inside.withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_take"))
        .select(*strata, F.struct("_h", F.col(key).alias("_k")).alias("_cut"))
    )
    # labels are 0/1, so `cuts` has two rows per value of `by`
    in_test = F.struct(F.col("_h"), F.col(key).alias("_k")) <= F.col("_cut")
    return (
        hashed.join(F.broadcast(cuts), strata, "left")
        .withColumn("part", F.when(F.coalesce(in_test, F.lit(False)), "test").otherwise("train"))
        .select(*df.columns, "part")
    )


def stratified_folds(
    df: DataFrame,
    *,
    key: str,
    label: str,
    seed: int | Column,
    folds: int = V.FOLDS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``fold`` in 0..k-1: sizes differ by at most one, overall and per label.

    One running rank goes through the labels one after the other in hash
    order and is dealt out round robin.
    """
    hashed = df.withColumn("_h", hash60(_seed(seed), F.lit("fold"), F.col(key))).withColumn(
        "_one", F.lit(1).cast("long")
    )
    ranked = running(
        hashed,
        groups=by,
        cells=[*integer_cells(F.col(label), (0,)), *hash_cells(F.col("_h"))],
        order=["_h", key],
        sums=["_one"],
    )
    return ranked.withColumn("fold", (F.col("_one_before") % folds).cast("int")).select(
        *df.columns, "fold"
    )


def numbered(df: DataFrame, *, key: str, seed: int) -> DataFrame:
    """Add ``position`` 0..n-1, dense, in seeded hash order."""
    hashed = df.withColumn("_h", hash60(F.lit(seed), F.lit("order"), F.col(key))).withColumn(
        "_one", F.lit(1).cast("long")
    )
    placed = running(
        hashed, cells=hash_cells(F.col("_h")), order=["_h", key], sums=["_one"]
    )
    return placed.withColumnRenamed("_one_before", "position").select(*df.columns, "position")


def bootstrap_sample(df: DataFrame, *, key: str, seed: int, n: int | None = None) -> DataFrame:
    """``n`` rows drawn with replacement (default: as many as there are).

    Draw i takes the row at position hash(seed, i) mod rows. The output says
    of itself that it is synthetic.
    """
    rows = numbered(df, key=key, seed=seed)
    size = df.agg(F.count("*").alias("n")).scalar()
    draws = (
        df.sparkSession.range(n).select(F.col("id").alias("draw"))
        if n is not None
        else rows.select(F.col("position").alias("draw"))
    )
    picked = draws.withColumn(
        "position", F.pmod(hash60(F.lit(seed), F.lit("draw"), F.col("draw")), size)
    )
    return picked.join(rows, "position").withColumn("synthetic", F.lit(True))


def split_audit(df: DataFrame, *, group: str, label: str) -> DataFrame:
    """Size, label rate and its distance from the whole, per part or fold."""
    per_group = df.groupBy(F.col(group).cast("string").alias("member")).agg(
        F.count("*").alias("n"), F.sum(label).alias("positives")
    )
    whole = df.agg(F.avg(label).alias("rate")).scalar()
    rate = F.col("positives") / F.col("n")
    return per_group.select(
        "member",
        "n",
        "positives",
        round_dp(rate, 6).alias("label_rate"),
        (F.abs(rate - whole) <= 0.02).alias("within_tolerance"),
    )


def overlap(df: DataFrame, *, key: str, part: str = "part") -> DataFrame:
    """Keys found in both parts; empty for a sound split."""
    train = df.where(F.col(part) == "train").select(key)
    return train.intersect(df.where(F.col(part) == "test").select(key))


def multi_seed(df: DataFrame, seeds: Sequence[int] = V.SEEDS) -> DataFrame:
    """One copy of every row per seed, for split columns of all seeds in one pass."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
