"""Numeric and key helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dp(value: Column, digits: int) -> Column:
    """Round half away from zero at ``digits`` decimals, by scaling.

    The same three IEEE steps run in any engine, so results compare bit by
    bit; ``round(x, d)`` works on the decimal text and differs near ties.
    """
    scale = float(10**digits)
    return F.round(value * F.lit(scale), 0) / F.lit(scale)


def hash60(*parts: Column) -> Column:
    """60-bit uniform integer from the md5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))  # typed as never null


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp (zone-less ones as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, null where whole is zero."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


# The characters Unicode calls white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Text without outer whitespace of any kind; plain ``trim`` knows spaces only."""
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def blank(value: Column) -> Column:
    """True where a value is null or whitespace only."""
    return value.isNull() | (strip(value) == "")
