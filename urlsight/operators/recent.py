"""De-duplication that remembers by count: a name is published unless it was among the last ones.

Names are numbered in the order they come in. A name is published if it was not published
within the last ``bound`` numbers, so at most ``bound`` names are ever remembered, and each
name's fate hangs on its own numbers only: from a row that is published, the next one is the
name's first row ``bound`` numbers on or later. The numbers are cut into stretches. Every stretch
is first run through from each row that its first publication of a name can be, the results are
chained name by name, and then every stretch marks its own rows. No task holds more than a stretch,
and the passes are as many for any number of names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: how many names the search path remembers.
RECENT = 20_000
#: Numbers in a stretch, or ten times the bound if that is more.
STRETCH = 200_000


def _next_rows(table: pa.Table, bound: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a stretch by name and number, whether a name begins, and each row's next publication.

    A row that is the last one to be published in the stretch has itself as the next.
    """
    codes = pc.dictionary_encode(table["domain"].combine_chunks(), null_encoding="encode").indices
    code, number = np.asarray(codes, dtype=np.int64), np.asarray(table["number"], dtype=np.int64)
    order = np.lexsort((number, code))
    code, number = code[order], number[order]
    # One ascending key: the names lie further apart than a step reaches.
    place = number - number.min()
    key = code * (place.max() + bound + 1) + place
    onward, own = np.searchsorted(key, key + bound), np.arange(len(key))
    inside = onward < len(key)
    inside[inside] = code[onward[inside]] == code[inside]
    return table.take(order), np.r_[True, code[1:] != code[:-1]], np.where(inside, onward, own)


def _published_from(bound: int, width: int, table: pa.Table) -> pa.Table:
    """``(domain, number, last)``: where a name's publications in a stretch can begin, and where they then end.

    That is the name's first row, a row that the stretch before can still hold back, or the first after those.
    """
    rows, begins, onward = _next_rows(table, bound)
    number = np.asarray(rows["number"])
    held = number % width < bound
    held[1:] |= held[:-1].copy()
    while not np.array_equal(further := onward[onward], onward):
        onward = further
    enters = np.flatnonzero(begins | held)
    return rows.take(enters).append_column("last", pa.array(number[onward[enters]]))


def _chained(bound: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by name and number those at which a stretch does begin."""
    name, free = None, None
    for batch in batches:
        kept = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("domain", "number", "last")))
        for k, (domain, number, last) in enumerate(rows):
            if free is None or domain != name or number >= free:
                kept.append(k)
                name, free = domain, last + bound
        yield batch.take(pa.array(kept, pa.int64())).select(["domain", "number"])


def _marked(bound: int, table: pa.Table, begun: pa.Table) -> pa.Table:
    """The rows of a stretch that are published, given the first one of each name."""
    rows, _, onward = _next_rows(table, bound)
    chosen = np.isin(np.asarray(rows["number"]), np.asarray(begun["number"]))
    at = np.flatnonzero(chosen)
    while len(at):
        at = onward[at][onward[at] != at]
        chosen[at] = True
    return rows.filter(pa.array(chosen)).select(["domain", "number"])


def published(names: DataFrame, bound: int = RECENT, remembered: DataFrame | None = None) -> DataFrame:
    """``(domain, number)`` of the names that are published, of a stored table with these columns.

    Numbers are not repeated. Of names that span no more than ``bound`` numbers, like those of a small
    micro-batch, the first occurrence is published, a combined minimum. Others take two passes over stretches
    of the numbers, which no name makes larger; what is chained by name between them is, of a name that
    fills a third of the rows, a tenth at most. ``remembered`` has at most ``bound`` rows ``(domain, last)``
    and is broadcast.
    """
    low, high = names.agg(F.min("number"), F.max("number")).first()
    free = names.select("domain", F.col("number").cast("long").alias("number"))
    if remembered is not None:
        free = free.join(F.broadcast(remembered), "domain", "left").filter(
            F.col("last").isNull() | (F.col("number") >= F.col("last") + bound)
        ).select("domain", "number")
    if low is None or high - low < bound:
        return stored(free.groupBy("domain").agg(F.min("number").alias("number")), "published")
    width = max(STRETCH, 10 * bound)
    pairs = "domain string, number long"

    def stretched(rows: DataFrame):
        return rows.groupBy(F.floor(F.col("number") / width).alias("stretch"))

    def entered(table: pa.Table) -> pa.Table:
        return _published_from(bound, width, table)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chained(bound, batches)

    def marked(table: pa.Table, begun: pa.Table) -> pa.Table:
        return _marked(bound, table, begun)

    ends = stretched(free).applyInArrow(entered, f"{pairs}, last long")
    begun = ends.repartition("domain").sortWithinPartitions("domain", "number").mapInArrow(chained, pairs)
    return stored(stretched(free).cogroup(stretched(begun)).applyInArrow(marked, pairs), "published")


def remembered_after(chosen: DataFrame, end: int, bound: int = RECENT, remembered: DataFrame | None = None) -> DataFrame:
    """What is remembered once the numbers below ``end`` are through: no more than ``bound`` rows."""
    rows = chosen.select("domain", F.col("number").alias("last"))
    if remembered is not None:
        rows = rows.unionByName(remembered.select("domain", "last"))
    return rows.filter(F.col("last") > end - bound).groupBy("domain").agg(F.max("last").alias("last"))
