"""Exact ranks and running totals without sorting everything in one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsight.functions.rows import computed_once
from urlsight.session import stored

BUCKET_VALUES = 50_000
PREFIX_STEP = 3
FEW_KEYS = 10_000
HEX_DIGITS = 30
BUCKET_ROWS = 1_000_000
SMALL_ROWS = 20_000


def value_bounds(values: DataFrame, value: str) -> list[float]:
    """Bounds that cut distinct values into buckets of about ``BUCKET_VALUES``.

    ``values`` has a row per distinct value (and group), so a value that fills most of a table
    weighs no more than others. One number per ``BUCKET_VALUES`` rows reaches the driver. As
    literals they make the bucket a pure function of the value, so a task that runs again puts
    every row where it was before.
    """
    finite = values.filter(F.abs(value) < float("inf"))
    buckets = math.ceil(finite.count() / BUCKET_VALUES)
    if buckets < 2:
        return []
    steps = [i / buckets for i in range(1, buckets)]
    bounds = finite.agg(F.percentile_approx(value, steps, 10 * buckets)).first()[0]
    return sorted({float(bound) for bound in bounds})


def _with_bucket(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    if not bounds:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(df)


def running_totals(
    counts: DataFrame,
    value: str,
    sums: list[str],
    by: list[str] | None = None,
    bounds: list[float] | None = None,
    descending: bool = True,
) -> DataFrame:
    """Add ``cum_<s>``, the total of ``s`` up to and including the row's value.

    ``counts`` holds one row per (``by``, ``value``), no value NULL or NaN. Also adds ``next_<s>``, the
    value of ``s`` in the following row. Each bucket is sorted on its own and gets the totals of
    the buckets before it, a table of one row per bucket and group, broadcast while it is small.
    """
    by = by or []
    counts = _with_bucket(counts, value, bounds or [])

    def along(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    inside = Window.partitionBy(*by, "_bucket").orderBy(along(value))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts
    for s in sums:
        rows = rows.withColumn(f"cum_{s}", F.sum(s).over(upto))
        rows = rows.withColumn(f"next_{s}", F.lead(s).over(inside))
    if not bounds:
        return rows.drop("_bucket")

    first = F.max_by if descending else F.min_by
    buckets = counts.groupBy(*by, "_bucket").agg(
        *[F.sum(s).alias(f"total_{s}") for s in sums],
        first(F.struct(*sums), value).alias("head"),
    )
    across = Window.partitionBy(*by).orderBy(along("_bucket"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"total_{s}").over(before), F.lit(0)).alias(f"before_{s}") for s in sums],
        F.lead("head").over(across).alias("next_head"),
    )
    offsets = F.broadcast(offsets) if len(bounds) < SMALL_ROWS else offsets
    rows = rows.join(offsets, [*by, "_bucket"])
    for s in sums:
        rows = rows.withColumn(f"cum_{s}", F.col(f"cum_{s}") + F.col(f"before_{s}"))
        rows = rows.withColumn(f"next_{s}", F.coalesce(f"next_{s}", F.col("next_head")[s]))
    return rows.drop("_bucket", "next_head", *[f"before_{s}" for s in sums])


def numbered(df: DataFrame, order: list[str], name: str = "number", start: int = 0) -> DataFrame:
    """``df``, stored, with consecutive numbers from ``start`` on in the given order.

    Rows are range-partitioned and sorted, so every task numbers its own; the offsets of the
    partitions, a row for each, are summed in one window. The order should be total:
    rows that are alike in it come in any order, and a value that fills much of the table is one task's.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part.alias("_part")).count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    return (
        rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.lit(start) + F.col("_before") + place).drop("_part", "_at", "_before")
    )


def hash_key(seed: int, column: str = "url") -> Column:
    """A key that orders rows at random but always alike: digest first, then the value."""
    return F.concat(F.md5(F.concat_ws(":", F.col(column), F.lit(str(seed)))), F.col(column))


def key_at_rank(
    df: DataFrame, key: Column, group: str, ranks: list[tuple]
) -> dict[tuple, str]:
    """The key at each ``(group, 1-based rank)``, ranked within the group.

    Instead of sorting, each pass counts the rows per next ``PREFIX_STEP`` hex digits of
    the key and goes on inside the one prefix that holds the rank. A pass is a scan with
    a small aggregate; at most 4096 counts per rank reach the driver. Keys are evenly
    spread, so 10^12 rows take four passes, and a hot group is no wider than others.
    """
    keyed = df.select(F.col(group).alias("_group"), key.alias("_key"))
    narrowing = {wanted: ("", wanted[1]) for wanted in ranks if wanted[1] > 0}
    found = {}
    width = 0
    while narrowing:
        inside = F.lit(False)
        for (g, _), (prefix, _) in narrowing.items():
            inside = inside | ((F.col("_group") == g) & F.col("_key").startswith(prefix))
        width += PREFIX_STEP
        counted = (
            keyed.filter(inside)
            .groupBy("_group", F.substring("_key", 1, width).alias("_prefix"))
            .count()
            .orderBy("_prefix")
            .collect()
        )
        still = {}
        for wanted, (outer, rank) in narrowing.items():
            for g, prefix, size in counted:
                if g != wanted[0] or not prefix.startswith(outer):
                    continue
                if rank <= size:
                    break
                rank -= size
            else:
                raise ValueError(f"group {wanted[0]!r} has fewer rows than rank {wanted[1]}")
            if size > FEW_KEYS and width < HEX_DIGITS:
                still[wanted] = (prefix, rank)
            else:
                found[wanted] = _nth_key(keyed, wanted[0], prefix, rank)
        narrowing = still
    return found


def _nth_key(keyed: DataFrame, group, prefix: str, rank: int) -> str:
    near = (
        keyed.filter((F.col("_group") == group) & F.col("_key").startswith(prefix))
        .orderBy("_key").offset(rank - 1).limit(2).collect()
    )
    if len(near) == 2 and near[0]["_key"] == near[1]["_key"]:
        raise ValueError("the rows are not distinct; remove duplicates before splitting")
    return near[0]["_key"]


def with_position(df: DataFrame, key: Column) -> DataFrame:
    """Add ``position``, the 1-based rank of an evenly spread hash key over all rows.

    Rows are ranked inside buckets, the first hex digits of the key, as many as keep a bucket
    near ``BUCKET_ROWS`` rows. Offsets are summed on two levels: over the buckets that share the
    first half of the digits, and over those halves, so no task sees more than the square root
    of the buckets. ``df`` is read twice and should be stored.
    """
    digits = 1 + max(math.ceil(math.log(max(df.count() / BUCKET_ROWS, 1), 16)), 1)
    keyed = computed_once(df, "_key", key).withColumn("_prefix", F.substring("_key", 1, digits))
    half = F.substring("_prefix", 1, digits // 2).alias("_half")
    counts = keyed.groupBy("_prefix", half).count()
    outer = Window.orderBy("_half").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_half").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    halves = counts.groupBy("_half").agg(F.sum("count").alias("_rows")).select(
        "_half", F.coalesce(F.sum("_rows").over(outer), F.lit(0)).alias("_outer")
    )
    offsets = counts.withColumn("_inner", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(
        halves, "_half"
    ).select("_prefix", (F.col("_outer") + F.col("_inner")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_prefix").orderBy("_key"))
    return (
        keyed.withColumn("_rank", rank)
        .join(F.broadcast(offsets) if 16 ** digits < SMALL_ROWS else offsets, "_prefix")
        .withColumn("position", F.col("_before") + F.col("_rank"))
        .drop("_key", "_prefix", "_rank", "_before")
    )
