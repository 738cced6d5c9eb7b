"""Keeping filters above columns that are costly to compute."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, columns: Mapping[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` plus the computed columns, which no filter is pushed through.

    A filter on a computed column is normally moved below the projection, with
    the column's expression put in its place. Where that rests on a chain of
    earlier steps, the substituted expression grows with every step. The
    columns are therefore produced by a one-row generator, whose output a
    filter cannot pass.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
