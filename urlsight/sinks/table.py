"""Writing the table of classified URLs: ``run=<run>/batch=<number>/dt=<day>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.sinks.batches import new_run

COLUMNS = ("url", "score", "classification", "time_added")


def with_day(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS, F.to_date("time_added").alias("dt"))


def lay_out(df: DataFrame) -> DataFrame:
    """Rows of a day brought together and sorted by class before the write.

    The rebalance hint lets adaptive execution cut a large day over many tasks and join
    small days into one file each; a plain ``repartition('dt')`` would put a whole day
    into one task. Sorting by class makes Parquet row-group statistics prune classes.
    """
    return (
        with_day(df)
        .hint("rebalance", "dt")
        .sortWithinPartitions("dt", "classification", "time_added")
    )


def write_batch(laid_out: DataFrame, folder: str) -> None:
    """One batch of a stream; written again it replaces itself."""
    laid_out.write.mode("overwrite").partitionBy("dt").parquet(folder)


def write_classified(df: DataFrame, path: str, mode: str = "append") -> None:
    """Add rows to the table as a run of one batch, next to those of streams and submissions."""
    keyed = with_day(df).withColumns({"run": F.lit(new_run()), "batch": F.lit(0).cast("bigint")})
    keyed.hint("rebalance", "dt").sortWithinPartitions(
        "run", "batch", "dt", "classification", "time_added"
    ).write.mode(mode).partitionBy("run", "batch", "dt").parquet(path)
