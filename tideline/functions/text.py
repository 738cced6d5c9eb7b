"""Folding of free wording onto the profile vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import strip

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
NUMBER_RUN = r"[0-9]+(?:[.,][0-9]+)*"


def normalize_text(value: Column) -> Column:
    """Lower case; every run outside [a-z0-9] becomes one space; no outer spaces."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def contains_phrase(normalized: Column, phrase: str) -> Column:
    """Whole-word, contiguous match of a phrase inside a normalised text."""
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(f" {phrase} ")


def yes_no(normalized: Column) -> Column:
    """Yes or No from whole words; null if neither or both kinds occur."""
    words = F.split(normalized, " ")
    yes = F.arrays_overlap(words, F.array(*map(F.lit, V.YES_WORDS)))
    no = F.arrays_overlap(words, F.array(*map(F.lit, V.NO_WORDS)))
    return F.when(yes & ~no, "Yes").when(no & ~yes, "No")


def _dictionary_value(needle: Column, wordings: Sequence[tuple[str, str]]) -> Column:
    """Exact hit, else the longest phrase (in words, then declared order) inside."""
    longest_first = sorted(wordings, key=lambda w: -len(w[0].split()))
    return F.coalesce(
        *[F.when(needle == phrase, canonical) for phrase, canonical in wordings],
        *[F.when(contains_phrase(needle, phrase), canonical) for phrase, canonical in longest_first],
    )


def _flag_value(needle: Column) -> Column:
    """Three fixed phrases in order, then plain yes/no words."""
    fixed = [
        F.when(contains_phrase(needle, phrase), canonical)
        for phrase, canonical in (V.NO_INTERNET, V.NO_PHONE, V.NOT_SUBSCRIBED)
    ]
    return F.coalesce(*fixed, yes_no(needle))


def _by_feature(feature: Column, values: dict[str, Column]) -> Column:
    case = None
    for name, value in values.items():
        case = F.when(feature == name, value) if case is None else case.when(feature == name, value)
    return case


def canon_category(
    feature: Column, needle: Column, dictionary: dict[str, tuple] = V.WORDINGS
) -> Column:
    """Dictionary value of a normalised wording.

    The dictionary is fixed and tiny, so it becomes a CASE expression: no
    join, no shuffle, and the row never leaves the generated code.
    """
    return _by_feature(
        feature, {name: _dictionary_value(needle, w) for name, w in dictionary.items()}
    )


def canon_service_flag(feature: Column, needle: Column) -> Column:
    """Value of a service flag from a normalised wording; the age flag knows
    plain yes/no words only."""
    return F.when(feature == V.FLAG, yes_no(needle)).when(
        feature.isin(*V.SERVICE_FLAGS), _flag_value(needle)
    )


def extract_number(value: Column) -> Column:
    """First plain number in the text, as text; null if there is none."""
    return F.nullif(F.regexp_extract(value, NUMBER, 0), F.lit(""))


def canon_value(feature: Column, value: Column, needle: Column) -> Column:
    """Canonical value of any feature, from the raw and the normalised wording;
    null where it cannot be read."""
    return (
        F.when(feature.isin(*V.WORDINGS), canon_category(feature, needle))
        .when(feature.isin(V.FLAG, *V.SERVICE_FLAGS), canon_service_flag(feature, needle))
        .when(feature.isin(*V.NUMERIC_FEATURES), extract_number(value))
        .otherwise(strip(value))
    )


def canonicalize(
    df: DataFrame, feature: str = "feature", value: str = "value", name: str = "canonical"
) -> DataFrame:
    """Add the canonical value of (feature, wording) rows.

    The wording is normalised once, in a step of its own.
    """
    folded = df.withColumn("_needle", normalize_text(F.col(value)))
    canonical = canon_value(F.col(feature), F.col(value), F.col("_needle"))
    return folded.withColumn(name, canonical).drop("_needle")


def grounded_number(value: Column, user_text: Column) -> Column:
    """True if the user's own text holds a number equal to the value."""

    def as_number(text: Column) -> Column:
        return F.regexp_replace(text, ",", "").try_cast("double")

    wanted = as_number(value)
    runs = F.regexp_extract_all(user_text, F.lit(f"({NUMBER_RUN})"), F.lit(1))
    found = F.exists(runs, lambda run: F.coalesce(as_number(run) == wanted, F.lit(False)))
    return F.when(value.isNotNull() & wanted.isNotNull(), found).otherwise(False)
