"""Reading the given tables and the word class shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def quoted(name: str) -> str:
    """The name of a column as an expression names it."""
    return "`" + name.replace("`", "``") + "`"


def text_of(column: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null, in order."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
