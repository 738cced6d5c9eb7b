"""Reading raw profile tables and writing cleaned ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.operators.cleaning import drop_identifier, expect_shape, trim_headers
from tideline.sources.checks import WriteChecks

_KEEP_SPACES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_profiles(
    spark: SparkSession,
    path: str | None = None,
    *,
    df: DataFrame | None = None,
    shape: tuple[int, int] | None = None,
    keep_key: bool = True,
    checks: WriteChecks | None = None,
) -> DataFrame:
    """A raw profile table from CSV or Parquet, or a table already read.

    CSV columns are all read as text, so nothing is guessed and no inference
    pass runs; the cleaning rules do the casts. Header names are trimmed. With
    ``shape`` the row and column count is asserted, with ``checks`` by the job
    that writes the table and without a pass of its own. The row key stays as a key
    outside the features unless ``keep_key=False`` drops it.
    """
    if df is None:
        if path is None:
            raise ValueError("give a path or a table")
        reader = spark.read
        df = (
            reader.parquet(path)
            if path.rstrip("/").endswith(".parquet")
            else reader.options(**_KEEP_SPACES).csv(path, header=True)
        )
    df = trim_headers(df)
    if shape is not None:
        df = expect_shape(df, *shape, checks=checks)
    without_key = drop_identifier(df)  # also checks that the key is there
    return df if keep_key else without_key


def write_clean(
    df: DataFrame, path: str, *, kind: str = "parquet", checks: WriteChecks | None = None
) -> str:
    """Overwrite a copy of the cleaned table and return its path.

    With ``checks`` one job writes and checks it, and nothing is overwritten
    unless all of them hold.
    """
    if checks is not None:
        options = {**_KEEP_SPACES, "header": "true"} if kind == "csv" else {}
        return checks.write(df, path, kind=kind, **options)
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.options(**_KEEP_SPACES).csv(path, header=True)
    else:
        writer.format(kind).save(path)
    return path


def features_of(df: DataFrame) -> list[str]:
    """Feature columns: everything but the row key and the label."""
    return [c for c in df.columns if c not in (V.ROW_KEY, V.LABEL, "label")]


def row_count(df: DataFrame) -> DataFrame:
    """Rows and columns as a one-row table."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns))
    )
