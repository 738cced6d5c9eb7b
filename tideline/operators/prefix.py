"""Running sums and carried values over globally ordered rows.

A window without a partition would sort the whole table in one task, and one
partitioned only by a hot group would do the same for that group. Here every
row gets a path of cells, coarse to fine, that follows the order. Rows are
ordered inside their finest cell only; the cell totals, which are few, are
accumulated level by level and added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COARSE = 1024  # cells per power of two
_FINE = 1024  # fine cells per coarse cell


_GROUP = "_group"


def group_key(groups: Sequence[str]) -> Column:
    """Group columns as one struct: never null itself, so rows of a null group
    meet in a join, and no filter is derived from it."""
    return F.struct(*groups)


def _never_null(cell: Column) -> Column:
    """Cells are join keys. Declared non-null they bring no IS NOT NULL filter,
    which Catalyst would push, with the whole expression behind it, to the scan.
    """
    return F.coalesce(cell.cast("long"), F.lit(0).cast("long"))


def value_cells(value: Column) -> list[Column]:
    """Two nested cells that never decrease as a double grows.

    They come from the exponent and the leading mantissa bits, so any
    distribution spreads: a fine cell covers a relative width of 1e-6, and yet
    there are few of them next to billions of values. Unlike sampled cut points
    they are the same in every run and on every retry. Both infinities and NaN,
    which sorts last, have cells of their own beyond all numbers.
    """
    nan, infinite = F.isnan(value), F.abs(value) == float("inf")
    number = F.when(nan | infinite, F.lit(1.0)).otherwise(value)
    size = F.abs(number)
    exponent = F.floor(F.log2(size))
    mantissa = size * F.pow(F.lit(2.0), -exponent) - 1.0
    place = mantissa * F.lit(float(_COARSE))
    sign = F.signum(number)
    tiny = size < 1e-300
    outside = F.when(nan, F.lit(1 << 41)).when(infinite, F.signum(value) * F.lit(1 << 40))
    coarse = F.when(nan | infinite, outside).when(tiny, F.lit(0)).otherwise(
        sign * ((exponent + 1100) * _COARSE + F.floor(place))
    )
    fine = F.when(nan | infinite | tiny, F.lit(0)).otherwise(
        sign * F.floor((place - F.floor(place)) * F.lit(float(_FINE)))
    )
    return [_never_null(coarse), _never_null(fine)]


def integer_cells(value: Column, shifts: Sequence[int]) -> list[Column]:
    """Nested cells of an integer order key, one per right shift."""
    return [_never_null(F.shiftright(value.cast("long"), s)) for s in shifts]


def hash_cells(h: Column) -> list[Column]:
    """Two nested cells of a uniform 60-bit hash, 512 x 512.

    A trillion rows leave four million in a cell, and the table of cell counts
    stays small whatever the row count.
    """
    return integer_cells(h, (51, 42))


def running(
    df: DataFrame,
    *,
    groups: Sequence[str] = (),
    cells: Sequence[Column],
    order: Sequence[str],
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
) -> DataFrame:
    """Add ``<s>_before`` per sum column and ``<c>_carried`` per last column.

    ``<s>_before`` is the sum over all earlier rows of the group, this row
    excluded. ``<c>_carried`` is the latest non-null value up to and including
    this row. Rows are ordered by the cells and then by ``order``, which must
    be unique within a group. A null group is a group like any other.
    """
    names = [f"_cell{i}" for i in range(len(cells))]
    rows = df.withColumns(dict(zip(names, cells)))
    group = []
    if groups:
        rows = rows.withColumn(_GROUP, group_key(groups))
        group = [_GROUP]
    # Cells first: a sort compares them as numbers before it looks into the group.
    leaf_keys = names + group
    before = Window.partitionBy(*leaf_keys).orderBy(*order)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaf = rows.withColumns(
        {f"{s}_before": F.sum(s).over(upto) - F.col(s) for s in sums}
        | {f"{c}_carried": F.last(c, ignorenulls=True).over(upto) for c in lasts}
    )

    # What a cell hands on is what its last row carries: one struct, however many columns.
    totals = (leaf if lasts else rows).groupBy(*leaf_keys).agg(
        *[F.sum(s).alias(s) for s in sums],
        *_held([F.col(f"{c}_carried").alias(c) for c in lasts], F.struct(*order)),
    )
    offsets = None
    for level in reversed(range(len(names))):
        parent, here = group + names[:level], names[level]
        earlier = (
            Window.partitionBy(*(parent or [F.lit(0)]))
            .orderBy(here)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        if lasts:
            totals = totals.select("*", "_held.*").drop("_held")
        step = totals.select(
            *parent,
            here,
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}{level}") for s in sums],
            *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}{level}") for c in lasts],
        )
        offsets = step if offsets is None else offsets.join(step, parent + [here])
        if level:
            now = Window.partitionBy(*parent).orderBy(here).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            carried = totals.withColumns({c: F.last(c, ignorenulls=True).over(now) for c in lasts})
            totals = carried.groupBy(*parent).agg(
                *[F.sum(s).alias(s) for s in sums],
                *_held([F.col(c) for c in lasts], F.col(here)),
            )
    levels = range(len(names))
    added = {}
    for s in sums:
        total = F.col(f"{s}_before")
        for i in levels:
            total = total + F.col(f"_{s}{i}")
        added[f"{s}_before"] = total
    for c in lasts:
        # the finest level is the most recent one
        added[f"{c}_carried"] = F.coalesce(
            F.col(f"{c}_carried"), *[F.col(f"_{c}{i}") for i in reversed(levels)]
        )
    helpers = names + [f"_{x}{i}" for x in (*sums, *lasts) for i in levels]
    return leaf.join(offsets, leaf_keys).withColumns(added).drop(*group, *helpers)


def _held(columns: Sequence[Column], stamp: Column) -> list[Column]:
    """The columns of the row with the greatest stamp, as one struct; nothing without columns."""
    return [F.max_by(F.struct(*columns), stamp).alias("_held")] if columns else []


def attach_totals(df: DataFrame, totals: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add per-group totals; without groups the single row is a scalar subquery."""
    if groups:
        keyed = totals.withColumn(_GROUP, group_key(groups)).drop(*groups)
        return df.withColumn(_GROUP, group_key(groups)).join(keyed, _GROUP).drop(_GROUP)
    held = df.withColumn("_totals", one_row(totals))
    return held.withColumns({c: F.col("_totals")[c] for c in totals.columns}).drop("_totals")


def one_row(df: DataFrame) -> Column:
    """A one-row table as a scalar struct.

    Put it into a column once and read its fields from there: every mention of
    the scalar itself would plan the subquery again.
    """
    return df.select(F.struct(*df.columns)).scalar()
