"""Messages packed in their order into batches, bounded by count and by bytes at once.

A batch takes messages as long as both bounds allow; the one that does not fit opens the next.
Where a batch begins hangs on all batches before it, but only through a small number: how many
messages of a stretch belong to the batch that came before. So every stretch is first run
through with each of these numbers, the results are chained, and then every stretch knows where
its own batches begin. No task sees more than a stretch.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The publisher's bounds of a batch.
MOST_MESSAGES = 10
MOST_BYTES = 256 * 1024
#: Messages in a stretch, and stretches whose results are chained in one task.
STRETCH = 10_000
CHAINED = 1_000


def ends_of_batches(sizes: np.ndarray, most: int, most_bytes: int) -> np.ndarray:
    """For each message the place after the batch that would begin with it."""
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ends = np.searchsorted(upto, upto[:-1] + most_bytes, "right") - 1
    first = np.arange(len(sizes))
    return np.clip(ends, first + 1, first + most)


def _stretches(messages: DataFrame, number: str, size: Column, most: int) -> DataFrame:
    """``(stretch, place, bytes)``; the first messages of a stretch end the one before it too."""
    rows = messages.select(F.col(number).alias("number"), size.cast("long").alias("bytes"))
    rows = rows.withColumns({
        "stretch": F.floor(F.col("number") / STRETCH), "place": F.pmod("number", F.lit(STRETCH)).cast("long"),
    })
    again = (F.col("place") < most - 1) & (F.col("stretch") > 0)
    ahead = rows.filter(again).withColumns({"stretch": F.col("stretch") - 1, "place": F.col("place") + STRETCH})
    return rows.unionByName(ahead).select("stretch", "place", "bytes")


def first_messages(
    messages: DataFrame, number: str, size: Column, most: int = MOST_MESSAGES, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """``(number, batch)``: a batch is named after the number of its first message.

    ``messages`` are numbered from 0 on without gaps. A message beyond ``most_bytes`` is a
    batch of its own.
    """
    rows = stored(_stretches(messages, number, size, most), "stretches")

    def opened(table: pa.Table) -> tuple[int, int, np.ndarray]:
        table = table.sort_by("place")
        sizes = np.asarray(table["bytes"], dtype=np.int64)
        own = int((np.asarray(table["place"]) < STRETCH).sum())
        return table["stretch"][0].as_py(), own, ends_of_batches(sizes, most, most_bytes)

    def left(table: pa.Table) -> pa.Table:
        """How many messages of the next stretch the last batch takes, for each number at the start."""
        stretch, own, ends = opened(table)
        out = []
        for place in range(most):
            while place < own:
                place = int(ends[place])
            out.append(place - own)
        return pa.table({"stretch": [stretch], "taken": pa.array([out], pa.list_(pa.field("element", pa.int32())))})

    results = stored(rows.groupBy("stretch").applyInArrow(left, "stretch long, taken array<int>"), "taken")
    begun = results.join(_taken_before(results, most), "stretch").select("stretch", "before")

    def assigned(key, table: pa.Table, starts: pa.Table) -> pa.Table:
        stretch, own, ends = opened(table)
        begin, place = np.zeros(own, dtype=bool), starts["before"][0].as_py()
        while place < own:
            begin[place] = True
            place = int(ends[place])
        at = np.arange(own)
        opener = np.maximum.accumulate(np.where(begin, at, -1))
        return pa.table({
            "number": pa.array(stretch * STRETCH + at, pa.int64()),
            "batch": pa.array(np.where(opener >= 0, stretch * STRETCH + opener, -1), pa.int64()),
        })

    found = rows.groupBy("stretch").cogroup(begun.groupBy("stretch")).applyInArrow(assigned, "number long, batch long")
    found = stored(found, "first-messages")
    # What belongs to a batch of the stretch before has the last name given there.
    last = found.groupBy(F.floor(F.col("number") / STRETCH).alias("stretch")).agg(F.max("batch").alias("open"))
    last = last.select((F.col("stretch") + 1).alias("stretch"), "open")
    inside, before = found.filter("batch >= 0"), found.filter("batch < 0")
    carried = before.withColumn("stretch", F.floor(F.col("number") / STRETCH)).join(last, "stretch")
    return inside.unionByName(carried.select("number", F.col("open").alias("batch")))


def _taken_before(results: DataFrame, most: int) -> DataFrame:
    """``(stretch, before)``: how many of a stretch's first messages the batch before it takes.

    Results are chained in groups of ``CHAINED`` stretches; one short list a group reaches the driver.
    """
    group = F.floor(F.col("stretch") / CHAINED)
    listed = results.groupBy(group.alias("group")).agg(
        F.sort_array(F.collect_list(F.struct("stretch", "taken"))).alias("entries")
    )
    whole = F.aggregate(
        "entries", F.array(*[F.lit(k) for k in range(most)]),
        lambda state, entry: F.transform(state, lambda place: F.get(entry["taken"], place)),
    )
    place, starts = 0, []
    for row in listed.select("group", whole.alias("taken")).orderBy("group").collect():
        starts.append((row["group"], place))
        place = row["taken"][place]
    spark = results.sparkSession
    entry = F.broadcast(spark.createDataFrame(starts, "group long, entry int"))
    chained = F.aggregate(
        "entries",
        F.struct(F.col("entry").alias("place"), F.array().cast("array<struct<stretch: bigint, before: int>>").alias("out")),
        lambda state, e: F.struct(
            F.get(e["taken"], state["place"]).alias("place"),
            F.concat(state["out"], F.array(F.struct(
                e["stretch"].alias("stretch"), state["place"].alias("before")
            ))).alias("out"),
        ),
        lambda state: state["out"],
    )
    return listed.join(entry, "group").select(F.inline(chained))


def message_batches(
    messages: DataFrame, number: str = "number", value: str = "value",
    most: int = MOST_MESSAGES, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """``(batch, n_messages, n_bytes, messages)`` of numbered messages, in their order.

    A batch has at most ``most`` messages, so the list is short. ``messages`` is read twice and
    should be stored.
    """
    size = F.coalesce(F.octet_length(value), F.lit(0))
    named = first_messages(messages, number, size, most, most_bytes)
    joined = messages.select(F.col(number).alias("number"), F.col(value).alias("value")).join(named, "number")
    listed = F.sort_array(F.collect_list(F.struct("number", "value")))
    return joined.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).cast("long").alias("n_bytes"),
        F.transform(listed, lambda m: m["value"]).alias("messages"),
    )
