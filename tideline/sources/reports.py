"""Report tables: one Parquet table, one partition per kind of report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, kind: str, run_id: str) -> str:
    """Append a report as JSON rows under its kind and return the path.

    Reports differ in their columns, so a row's content is one JSON text.
    """
    body = F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"})
    report.select(
        F.lit(run_id).alias("run_id"), body.alias("body"), F.lit(kind).alias("kind")
    ).write.mode("append").partitionBy("kind").parquet(path)
    return path


def read_report(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of one kind of report: (run_id, body); other kinds are not read."""
    return spark.read.parquet(path).where(F.col("kind") == kind).select("run_id", "body")
