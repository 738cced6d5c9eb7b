"""Profiles that build up over the turns of a session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.prefix import integer_cells, running

TIME_SHIFTS = (42, 32)  # cells of about 51 days and 71 minutes in microseconds


def session_profile(
    turns: DataFrame,
    *,
    session: Sequence[str],
    order: Sequence[str],
    facts: Mapping[str, Column],
    shifts: Sequence[int] = TIME_SHIFTS,
) -> DataFrame:
    """Per turn, the latest value of every feature stated so far in its session.

    A later value replaces an earlier one; silence keeps it. ``order`` starts
    with an integer (a time or a turn number) whose shifts cut every session
    into cells, so sessions of any length take the same plan.
    """
    stated = {f"_f{i}": value for i, value in enumerate(facts.values())}
    carried = running(
        turns.withColumns(stated),
        groups=session,
        cells=integer_cells(F.col(order[0]), shifts),
        order=order,
        lasts=list(stated),
    )
    latest = {f: F.col(f"_f{i}_carried") for i, f in enumerate(facts)}
    return carried.withColumns(latest).drop(*stated, *[f"{n}_carried" for n in stated])


def final_profile(
    turns: DataFrame, *, session: Sequence[str], order: Sequence[str], facts: Mapping[str, Column]
) -> DataFrame:
    """The state of every session after its last turn: one aggregation, no sort."""
    stamp = F.struct(*order)
    return turns.groupBy(*session).agg(
        *[F.max_by(value, F.when(value.isNotNull(), stamp)).alias(f) for f, value in facts.items()]
    )


def session_epochs(
    turns: DataFrame,
    *,
    session: Sequence[str],
    order: Sequence[str],
    reset: Column,
    shifts: Sequence[int] = TIME_SHIFTS,
) -> DataFrame:
    """Add ``epoch``: resets of the session before or at this turn.

    Facts from before a reset no longer count, so a profile is kept per
    (session, epoch).
    """
    counted = running(
        turns.withColumn("_reset", reset.cast("long")),
        groups=session,
        cells=integer_cells(F.col(order[0]), shifts),
        order=order,
        sums=["_reset"],
    )
    return counted.withColumn("epoch", F.col("_reset_before") + F.col("_reset")).drop(
        "_reset", "_reset_before"
    )


def facts_map(features: Sequence[str]) -> Column:
    """The stated features of a row as a map, silent ones left out."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f).isNotNull(),
                    F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")),
                )
                for f in features
            ]
        )
    )
    return F.map_from_entries(entries)


def facts_text(facts: Column) -> Column:
    """A facts map as 'feature=value, ...' in feature order."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(facts)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        ),
        ", ",
    )
