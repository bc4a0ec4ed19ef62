"""A stream of numbered records from a service that is asked for what lies above an id.

The highest id is the offset, so the stream's checkpoint is its resume state, and a restart asks
for nothing twice. A service answers two questions, which is the highest id and which records lie between two
ids; ``FolderService`` answers them from a folder of Parquet files, another from a paged interface.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ids that one task asks for.
IDS_A_TASK = 100_000
#: Rows of a batch, and bytes of a column read at once: a task's memory hangs on these, not on the folder.
ROWS_A_BATCH = 10_000
BUFFER_BYTES = 1 << 20


class FolderService:
    """Records of Parquet files with a column ``id``, in a folder that all workers can open.

    File statistics tell the highest id and leave out the files that have none of the wanted ones.
    Records without an id, or with an id of zero or below, are never asked for.
    """

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.path = path.removeprefix("file:") if path.startswith("file:/") else path

    def _files(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet")

    def highest(self) -> int:
        highest = 0
        for piece in self._files().get_fragments():
            for group in piece.row_groups:
                seen = (group.statistics or {}).get("id")
                if seen is None:
                    found = piece.to_table(columns=["id"])["id"]
                    seen = {"max": pc.max(found).as_py()}
                highest = max(highest, seen["max"] or 0)
        return highest

    def between(self, low: int, high: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The records file by file, a few rows at a time; the scan of a dataset holds whole row groups, many at once."""
        wanted = (ds.field("id") > low) & (ds.field("id") <= high)
        for piece in self._files().get_fragments(wanted):
            groups = [group.id for group in piece.subset(wanted).row_groups]
            with pq.ParquetFile(piece.open(), buffer_size=BUFFER_BYTES, pre_buffer=False) as file:
                for batch in file.iter_batches(ROWS_A_BATCH, groups, [*{"id", *names}], use_threads=False):
                    yield batch.filter(wanted).select(names)


@dataclass
class Ids(InputPartition):
    """The ids above ``low`` up to ``high``."""

    low: int
    high: int


class RecordReader(DataSourceStreamReader):
    def __init__(self, service: FolderService, schema: StructType, start: int, step: int):
        self.service, self.schema, self.start, self.step = service, schema, start, step

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"id": max(self.start, self.service.highest())}

    def partitions(self, start: dict, end: dict) -> list[Ids]:
        cuts = [*range(start["id"], end["id"], self.step), end["id"]]
        return [Ids(low, high) for low, high in zip(cuts, cuts[1:])]

    def read(self, partition: Ids) -> Iterator[pa.RecordBatch]:
        for batch in self.service.between(partition.low, partition.high, self.schema.names):
            if batch.num_rows:
                yield batch

    def commit(self, end: dict) -> None:
        """Nothing to keep: the offset lies in the checkpoint."""


class RecordSource(DataSource):
    """Format ``numbered-records``: options ``path``, ``start`` (an id, 0) and ``ids_a_task``."""

    service = FolderService

    @classmethod
    def name(cls) -> str:
        return "numbered-records"

    def schema(self) -> str:
        return "id bigint, name_value string, common_name string"

    def streamReader(self, schema: StructType) -> RecordReader:  # noqa: N802
        start, step = int(self.options.get("start", 0)), int(self.options.get("ids_a_task", IDS_A_TASK))
        return RecordReader(self.service(dict(self.options)), schema, start, step)


def record_stream(spark, path: str, start: int = 0, source: type[RecordSource] = RecordSource):
    """Records above ``start`` as a stream that goes on from its checkpoint."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("start", start).load(path)
