"""Laying out the closed days of a table that streams write in many small files.

A job rewrites the rows of closed days under a run of its own and then notes, in one file, which
runs and batches it has taken over. Readers leave out what is taken over and the runs of jobs
that noted nothing, so rows are there once at every moment: a job that breaks off leaves
nothing that is read, and one that runs again finds only what is not laid out yet. Conditions are literal
bounds on partition columns, so the files that were taken over are not opened.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.schemas import CLASSIFIED_DDL
from urlsight.sinks.batches import batch_path, new_run, read_batches
from urlsight.sinks.feed import opened
from urlsight.sinks.table import lay_out, write_batch

PREFIX = "layout-"
TAKEN = "of_run string, upto bigint, before date, run string"


def _log(path: str) -> str:
    return f"{path.rstrip('/')}-layout"


def taken_over(spark: SparkSession, path: str) -> tuple[list[str], dict[str, tuple[int, str]]]:
    """The runs of finished jobs, and of each run the batches and days that were taken over.

    Later jobs go further in both, so of each run only the furthest bounds count.
    """
    try:
        noted = spark.read.schema(TAKEN).json(_log(path)).collect()
    except AnalysisException:
        return [], {}
    bounds: dict[str, tuple[int, str]] = {}
    for row in noted:
        upto, before = bounds.get(row["of_run"], (-1, ""))
        bounds[row["of_run"]] = (max(upto, row["upto"]), max(before, str(row["before"])))
    return sorted({row["run"] for row in noted}), bounds


def current(spark: SparkSession, path: str) -> Column:
    """Which rows of the table, by run, batch and dt, are there to be read."""
    jobs, bounds = taken_over(spark, path)
    run = F.col("run")
    keep = ~run.startswith(PREFIX)
    if jobs:
        keep = keep | run.isin(jobs)
    for of_run, (upto, before) in bounds.items():
        keep = keep & ~((run == of_run) & (F.col("batch") <= upto) & (F.col("dt") < F.lit(before).cast("date")))
    return keep


def _note(spark: SparkSession, path: str, taken: list[tuple]) -> None:
    """One small file, so that all of a job counts or nothing."""
    rows = spark.createDataFrame(taken, "of_run string, upto bigint, before string, run string")
    rows.coalesce(1).write.mode("append").json(_log(path))


def lay_out_closed_days(spark: SparkSession, path: str, before: str) -> int:
    """Rewrite the rows of days before ``before`` that no job has laid out; the number of rows.

    The newest batch of a run with several is left for the next job, because its writer may
    still be at work. Run it when the days are closed, not two jobs at a time.
    """
    try:
        table = read_batches(spark, path, f"{CLASSIFIED_DDL}, dt date")
    except AnalysisException:
        return 0
    ends = table.filter(~F.col("run").startswith(PREFIX)).groupBy("run").agg(F.max("batch").alias("last")).collect()
    before = max([before, *[b for _, b in taken_over(spark, path)[1].values()]])
    upto = {r["run"]: max(r["last"] - 1, 0) for r in ends}
    mine = F.lit(False)
    for run, last in upto.items():
        mine = mine | ((F.col("run") == run) & (F.col("batch") <= last))
    rows = table.filter(current(spark, path) & mine & (F.col("dt") < F.lit(before).cast("date")))
    job = f"{PREFIX}{new_run()}"
    write_batch(lay_out(rows), batch_path(path, job, 0))
    written = read_batches(spark, path, f"{CLASSIFIED_DDL}, dt date").filter(F.col("run") == job).count()
    if written:
        _note(spark, path, [(run, last, before, job) for run, last in upto.items()])
    return written


def drop_laid_out(spark: SparkSession, path: str) -> int:
    """Delete the files that jobs have taken over; the number of them. For when no reader is older than the last job."""
    folders = (
        read_batches(spark, path, f"{CLASSIFIED_DDL}, dt date").filter(~current(spark, path))
        .select("run", "batch", "dt").distinct().collect()
    )
    for row in folders:
        system, place = opened(f"{batch_path(path, row['run'], row['batch'])}/dt={row['dt']}")
        system.delete_dir(place)
    return len(folders)
