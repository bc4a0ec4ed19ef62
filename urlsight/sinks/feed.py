"""A feed of alerts whose batches are published whole.

Tasks stage their rows in files of their own. Only when all of them are done is the batch published,
by moving a manifest that names its files into place. A reader follows manifests, so it sees a
batch as a whole or not at all; what a failed task or a failed commit has left is named by none.
A batch that runs again replaces its manifest.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from urlsight.sinks.batches import run_of
from urlsight.sinks.messages import alert_messages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST = "batch bigint, files array<string>, rows bigint, run string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def put_whole(path: str, lines: list[str]) -> None:
    """Write a file so that it is there with all its lines or not at all."""
    system, place = opened(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    passing = f"{place.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        out.write("".join(f"{line}\n" for line in lines).encode())
    system.move(passing, place)


@dataclass
class Staged(WriterCommitMessage):
    """The file that a task has staged; none for a task without rows."""

    file: str | None
    rows: int


class FeedWriter(DataSourceStreamWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def write(self, rows: Iterator[Row]) -> Staged:
        name, count = f"staged/{self.run}-{uuid.uuid4().hex}.json", 0
        system, place = opened(f"{self.path}/{name}")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place) as out:
            for row in rows:
                out.write(f"{row['value']}\n".encode())
                count += 1
        return Staged(name if count else None, count)

    def _manifest(self, batch: int) -> str:
        return f"{self.path}/published/run={self.run}/{batch:019d}.json"

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        done = [m for m in messages if m is not None]
        manifest = {"batch": batchId, "files": [m.file for m in done if m.file], "rows": sum(m.rows for m in done)}
        put_whole(self._manifest(batchId), [json.dumps(manifest)])

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        """Remove the staged files of a batch that failed; it comes again with files of its own.

        A commit can fail after its manifest is in place. What that names is published and stays.
        """
        system, place = opened(self._manifest(batchId))
        named = []
        if system.get_file_info(place).type == fs.FileType.File:
            named = json.loads(system.open_input_stream(place).read())["files"]
        for message in messages:
            if message is not None and message.file and message.file not in named:
                system.delete_file(opened(f"{self.path}/{message.file}")[1])


class AlertFeed(DataSource):
    """Format ``alert-feed``: options ``path`` and ``run``; rows have one column ``value``."""

    writer = FeedWriter

    @classmethod
    def name(cls) -> str:
        return "alert-feed"

    def streamWriter(self, schema: StructType, overwrite: bool) -> FeedWriter:  # noqa: N802
        return self.writer(self.options["path"], self.options["run"])


def feed_stream(rows: DataFrame, path: str, checkpoint: str, source: type[AlertFeed] = AlertFeed) -> DataStreamWriter:
    """New rows as JSON lines in a feed, for whoever subscribes to it; a new checkpoint adds a run."""
    spark = rows.sparkSession
    spark.dataSource.register(source)
    return (
        alert_messages(rows).writeStream.format(source.name()).option("path", path)
        .option("run", run_of(spark, checkpoint)).option("checkpointLocation", checkpoint)
    )


def published_batches(spark: SparkSession, path: str) -> DataFrame:
    """``(run, batch, files, rows)`` of what is published so far."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/published")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def read_feed(spark: SparkSession, path: str, schema: str, after: dict[str, int] | None = None) -> DataFrame:
    """The rows of all published batches, or of those after the last batch seen of each run."""
    batches = published_batches(spark, path)
    for run, batch in (after or {}).items():
        batches = batches.filter((F.col("run") != run) | (F.col("batch") > batch))
    files = [r["file"] for r in batches.select(F.explode("files").alias("file")).collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{name}" for name in files])
