"""Shards of near equal size by sampled splitters, in DataFrame operations only.

Rows are ordered by a key, a hash of the text followed by a hash of the id, so equal texts are
neighbours and yet a large group of them can be cut anywhere. A sample in which a row's chance
grows with its size gives quantile boundaries; ranges that turn out overfull are sampled again
and subdivided. Sizes are added up range by range, and a row's shard follows from the bytes
before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsight.llm.stored import plain, small, stored

SHARDS = 16
#: Rows of a range at most, about; number of ranges at least and at most; sampled keys a range.
RANGE_ROWS = 100_000
RANGES = (256, 8192)
KEYS = 8
ROUNDS = 3
_LAST = "~"


def _hex(column: Column) -> Column:
    return F.lpad(F.hex(column), 16, "0")


def sort_key(id: Column, text: Column) -> Column:
    return F.concat(_hex(F.xxhash64(F.coalesce(text, F.lit("")))), _hex(F.xxhash64(id)))


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow rows ``id, size, crc, key, draw``; the size is that of the text in bytes plus one."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col(plain(id)).alias("id"), F.col(plain(text)).alias("text")).select(
        "id", (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("crc"),
        sort_key(F.col("id"), F.col("text")).alias("key"),
        (F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / float(1 << 53)).alias("draw"),
    )


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are not above the key, by binary search in a constant array."""
    steps = len(bounds).bit_length()
    full = bounds + [_LAST] * ((1 << steps) - 1 - len(bounds))
    table = F.split(F.lit(",".join(full)), ",")
    return F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)]), F.lit(0),
        lambda at, step: at + F.when(F.get(table, at + step - 1) <= key, step).otherwise(0),
    ) if bounds else F.lit(0)


def sampled(rows: DataFrame, total: int, keys: int) -> list[tuple[str, float]]:
    """About ``keys`` keys in order, each with the number of equal shares of the bytes it stands for."""
    rate = keys / max(total, 1)
    chosen = rows.filter(F.col("draw") < F.col("size") * rate)
    weight = F.greatest(F.lit(1.0), F.col("size") * rate)
    found = chosen.groupBy("key").agg(F.sum(weight).alias("weight")).collect()
    return sorted((r["key"], r["weight"]) for r in found)


def quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys that cut the sample into ``parts`` of like weight."""
    whole, bounds, seen = sum(w for _, w in sample), [], 0.0
    for key, weight in sample:
        if seen * parts >= whole * (len(bounds) + 1):
            bounds.append(key)
        seen += weight
    return bounds


def splitters(rows: DataFrame) -> list[str]:
    """Boundaries of ranges with like bytes. At most ``RANGES[1] * KEYS`` keys reach the driver."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = min(max(RANGES[0], math.ceil(count / RANGE_ROWS)), RANGES[1])
    bounds = quantiles(sampled(rows, total, parts * KEYS), parts)
    for _ in range(ROUNDS):
        sizes = rows.groupBy(range_of(F.col("key"), bounds).alias("range")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows")
        )
        limit = 2 * total / parts
        full = sizes.filter((F.col("bytes") > limit) & (F.col("rows") > 1)).collect()
        if not full or len(bounds) >= 2 * RANGES[1]:
            break
        inside = rows.filter(range_of(F.col("key"), bounds).isin([r["range"] for r in full]))
        weight = sum(r["bytes"] for r in full)
        finer = quantiles(sampled(inside, weight, 4 * len(full) * KEYS), 4 * len(full))
        grown = sorted({*bounds, *finer})
        if len(grown) == len(bounds):
            break
        bounds = grown
    return bounds


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (stored, as of ``keyed``) plus ``shard`` and ``slot``, gapless from 0 in each shard.

    A shard's bytes differ from an equal share by one row at most on either side. An empty table
    gives an empty result, repeated rows are placed one by one.
    """
    placed = stored(rows.withColumn("range", range_of(F.col("key"), splitters(rows))))
    sums = stored(placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("count")))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(stored(sums.select(
        "range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )))
    inside = Window.partitionBy("range").orderBy("key", "id", "size", "crc")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = placed.withColumn("upto", upto).withColumn("number", F.row_number().over(inside)).join(offsets, "range")
    shard = F.expr(f"((2 * (bytes_before + upto) - size) * {shards}) div (2 * total)")
    ranked = stored(
        summed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
        .withColumn("rank", F.col("rows_before") + F.col("number") - 1)
        .select(*rows.columns, "shard", "rank")
    )
    firsts = small(stored(ranked.groupBy("shard").agg(F.min("rank").alias("first"))))
    return ranked.join(firsts, "shard").withColumn("slot", F.col("rank") - F.col("first")).select(
        *rows.columns, "shard", "slot"
    )


def shard(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, slot.

    A null text has no bytes and size 1; a null id is a value like any other.
    """
    placed = assign(stored(keyed(docs, id, text)), shards)
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write all columns of ``docs`` below ``path``, a folder ``shard=<n>`` for each shard.

    Rows with the same id and text go into one shard, the first of theirs.
    """
    places = assign(stored(keyed(docs, id, text)), shards).groupBy("key").agg(F.min("shard").alias("__shard"))
    rows = docs.withColumn("__key", sort_key(F.col(plain(id)), F.col(plain(text))))
    joined = rows.join(places.withColumnRenamed("key", "__key"), "__key").drop("__key", "shard")
    joined.withColumnRenamed("__shard", "shard").hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
