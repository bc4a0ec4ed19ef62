"""Mixes sources to target weights by weighted fair queueing.

Every source is shuffled and queued, again and again if its target is larger than it is. A
document's virtual finish time is the number of its source's tokens up to its end, divided by
the source's target. The mix is all documents in the order of finish times, cut off where the
budget is used up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsight.llm.stored import identified, plain, small, stored

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Rows that one task sorts to add up sizes, about, and groups of a source at least.
GROUP_ROWS = 50_000
LEAST_GROUPS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """``(source, place, source_size, target)`` from ``sizes(source, source_size)``.

    Sources in code point order, null last, get the weights in turn and share the sum of all
    sizes. A target stops at ``passes`` times its source; what is too much is shared by the
    others by weight. That is one water level: a target is the lesser of its cap and the level
    times its weight, and the level follows from the sources in the order of cap over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(by_name).cast("long")).withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    everything = Window.partitionBy()
    filled = placed.withColumns({
        "cap": (F.col("source_size") * passes).cast("double"),
        "level": (
            F.sum("source_size").over(everything)
            - F.coalesce(F.sum(F.col("source_size") * passes).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ) / F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "turn": F.row_number().over(by_fill),
    })
    stops = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))
    return filled.withColumn("level", F.min(stops).over(everything)["level"]).select(
        "source", "place", "source_size",
        F.least("cap", F.col("level") * F.col("weight")).alias("target"),
    )


def queue(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``rows(row, id, source, size)`` plus place, source_size, target and ``upto``.

    ``upto`` is the number of the source's tokens up to the row's end in shuffled order. It is
    added up in groups, ranges of the shuffle key, so that a source with a third of all rows is
    spread over many tasks; the totals of the groups follow.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    groups = max(LEAST_GROUPS, math.ceil(rows.count() / GROUP_ROWS))
    first = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    group = F.shiftright(first * F.lit(groups), 32)
    drawn_rows = rows.withColumn("draw", drawn).withColumn("group", group)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = small(stored(targets(sizes)))
    placed = drawn_rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.*", "place", "source_size", "target"
    )
    placed = stored(placed)
    totals = stored(placed.groupBy("place", "group").agg(F.sum("size").alias("total")))
    ahead = Window.partitionBy("place").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("place", "group", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("place", "group").orderBy("draw", "id", "size", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = placed.withColumn("upto", F.sum("size").over(inside))
    return (
        running.join(offsets, ["place", "group"])
        .withColumn("upto", F.col("upto") + F.col("before")).drop("before", "group")
    )


def schedule(queued: DataFrame, passes: int = MOST_PASSES) -> DataFrame:
    """The mix: a row for each document and pass in it, with its finish time and ``position``.

    ``position`` is the number of tokens of the mix up to the row's end. Only passes that start
    before their source's target is reached can be in it: with shares of the whole budget as
    targets, all sources finish at time 1. Finish times are spread evenly over tokens, so ranges
    of time are ranges of like size; they are summed on their own and then offset.
    """
    again = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    starts = F.col("pass") * F.col("source_size") + F.col("upto") - F.col("size")
    timed = (
        queued.select("*", again).filter((F.col("target") > 0) & (starts < F.col("target")))
        .withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target"))
    )
    ranges = max(LEAST_GROUPS, 4 * math.ceil(queued.count() / GROUP_ROWS))
    timed = stored(timed.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges))))
    totals = stored(timed.groupBy("range").agg(F.sum("size").alias("total")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(stored(totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))))
    inside = Window.partitionBy("range").orderBy("finish", "place", "draw", "id", "pass", "size", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    budget = small(stored(queued.select("place", "source_size").distinct().agg(F.sum("source_size").alias("budget"))))
    summed = timed.withColumn("upto", F.sum("size").over(inside))
    return (
        summed.join(offsets, "range").withColumn("position", F.col("upto") + F.col("before"))
        .join(budget, F.col("position") <= F.col("budget")).drop("upto", "before", "budget", "range")
    )


def narrow(docs: DataFrame, id: str, source: str, text: str) -> DataFrame:
    return docs.select(
        F.col(plain(id)).alias("id"), F.col(plain(source)).alias("source"),
        word_count(F.col(plain(text))).alias("size"), F.xxhash64(F.col(plain(text))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def takes(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, times, taken, key.

    ``times`` says how often the mix takes the document, at most ``MOST_PASSES`` times. A null
    text has size 0, a null source is a source of its own, a null id is shuffled like an empty
    one; repeated rows are queued one by one. An empty table gives an empty result.
    """
    queued = stored(queue(stored(narrow(docs, id, source, text)), seed))
    counts = schedule(queued).groupBy("row").agg(F.count("*").alias("times"))
    times = F.coalesce("times", F.lit(0))
    return queued.join(counts, "row", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        times.alias("times"), (times * F.col("size")).alias("taken"), "key",
    )


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Rows are found again by id and a hash of the text, so ids need not be unique.
    """
    counts = (
        takes(docs, id, source, text, seed).groupBy(F.col("doc_id").alias("id"), "key")
        .agg(F.sum("times").alias("times")).filter("times > 0")
    )
    rows = identified(docs, id, text).alias("d").join(
        counts.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & F.col("d.key").eqNullSafe(F.col("c.key"))
    ).select("d.row", "d.id", "d.key", "c.times")
    again = rows.dropDuplicates(["id", "key"]).select("row", F.explode(F.sequence(F.lit(1), "times")))
    return again.select("row.*")
