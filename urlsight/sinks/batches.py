"""Folders that many writers add to: every run and batch has a place of its own.

``<path>/run=<run>/batch=<number>/...``. A stream's run goes with its checkpoint, so a batch
that is written again after a crash replaces itself, while a new checkpoint, a batch job or a
submission adds to what is there. Runs sort by the time they began.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

KEYS = "run string, batch bigint"


def new_run() -> str:
    return f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:8]}"


def noted_run(spark: SparkSession, checkpoint: str) -> str | None:
    """The run that belongs to a checkpoint; none where no writer was ever made with it."""
    try:
        noted = spark.read.text(f"{checkpoint}/run").first()
    except AnalysisException:
        return None
    return noted["value"] if noted else None


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The run that belongs to a checkpoint; it is noted there when the checkpoint is new."""
    run = noted_run(spark, checkpoint)
    if not run:
        run = new_run()
        noted = spark.createDataFrame([(run,)], "value string").coalesce(1)
        noted.write.mode("overwrite").text(f"{checkpoint}/run")
    return run


def batch_path(path: str, run: str, batch: int) -> str:
    return f"{path}/run={run}/batch={batch}"


def keyed_writer(
    rows: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, str], None], mode: str = "append"
) -> DataStreamWriter:
    """A stream writer that hands each batch to ``write`` with the folder it must overwrite."""
    run = run_of(rows.sparkSession, checkpoint)

    def each(batch: DataFrame, number: int) -> None:
        write(batch, batch_path(path, run, number))

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)


def read_batches(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """What all runs have written, with their ``run`` and ``batch``."""
    return spark.read.schema(f"{schema}, {KEYS}").format(file_format).load(path)
