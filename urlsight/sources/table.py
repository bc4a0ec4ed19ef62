"""The table of classified URLs: one folder per day, rows clustered by class."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.schemas import CLASSIFIED_DDL
from urlsight.sinks.batches import read_batches
from urlsight.sinks.layout import PREFIX, current


def read_classified(spark: SparkSession, path: str) -> DataFrame:
    """Scan of the table, whoever wrote its rows; ``dt`` is its partition column.

    Rows that a layout job has rewritten are read from the new files only.
    """
    rows = read_batches(spark, path, f"{CLASSIFIED_DDL}, dt date")
    return rows.filter(current(spark, path)).drop("run", "batch")


def stream_classified(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table as a stream, as they are added; files of layout jobs add none."""
    reader = spark.readStream.schema(CLASSIFIED_DDL).option("recursiveFileLookup", "true")
    return reader.parquet(path).filter(~F.contains(F.col("_metadata.file_path"), F.lit(f"/run={PREFIX}")))


def moment(as_of: datetime | Column | None) -> Column:
    """The reference time of a query; the current time unless one is given, in UTC if naive."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC))


def since(
    df: DataFrame,
    as_of: datetime | Column | None,
    interval: str,
    column: str = "time_added",
    part: str = "dt",
) -> DataFrame:
    """Rows not older than ``interval`` before ``as_of``; later rows count as well.

    The day partition is no function of the time for the planner, so where the table has
    one the day bound is stated too: only then are older folders left out of the scan.
    """
    start = moment(as_of) - F.expr(f"INTERVAL {interval}")
    recent = F.col(column) >= start
    if part in df.columns:
        recent = (F.col(part) >= F.to_date(start)) & recent
    return df.filter(recent)
