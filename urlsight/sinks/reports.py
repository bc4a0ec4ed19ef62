"""Small result tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv_report(report: DataFrame, path: str) -> None:
    """One CSV file with a header; for the metric tables, which have at most ten rows."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
