"""Hard negatives for anchors of an embedding table, by a secondary-sort shuffle.

Vectors are rounded to integers, so that scores (inner products) are exact. Anchors, a stated
query set, meet all rows block by block; of a block only what can matter is kept: the best rows
of an anchor's label, and the best other rows below each of its positives. These pair
scores are packed into (anchor, descending score, id) keys, partitioned by anchor and sorted
inside the partitions; an iterator over the sorted rows opens a window for each positive and
emits the negatives that fall into it. No anchor's rows are ever held together.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.llm.stored import plain, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A component ``x`` counts as ``floor(SCALE * x)``.
SCALE = 256
#: Components in a block of rows, anchors in a block of anchors, anchors scored at once.
BLOCK_CELLS = 1 << 20
ANCHORS = 1024
AT_ONCE = 128
#: Bytes of anchors up to which every task gets all of them; beyond, blocks meet in a shuffle.
MOST_BROADCAST = 32 << 20
#: Copies of a block of anchors in that shuffle, each for its share of the row blocks.
SHARES = 32

BLOCK = "first long, ids array<long>, labels array<long>, anchors array<int>, width int, kind string, data binary"
ANCHOR = "row long, id long, label long, vector binary"
FOUND = "key binary, anchor_id long"
POSITIVES = "row long, anchor_id long, positive_id long, score long, key binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

_TOP = np.uint64(1 << 63)
#: Anchor's row, complement of the score, 0 for its own label and 1 for others, no id, id.
_KEY = np.dtype([("row", ">u8"), ("score", ">u8"), ("other", "u1"), ("no_id", "u1"), ("id", ">u8")])
_BYTES = np.dtype(("V", _KEY.itemsize))
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Rule:
    """The first ``positives`` rows of an anchor's label, and for each of them the first
    ``negatives`` others that score between ``low`` and ``high`` percent of it."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90

    def window(self, score: int) -> tuple[int, int]:
        """The least and the greatest score of a negative."""
        return -(-self.low * score // 100), self.high * score // 100


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``; what a long cannot hold becomes the nearest long."""
    floored = np.floor(values.astype(np.float64) * SCALE)
    inside = np.clip(floored, -(2.0**63), 2.0**63 - 1024)
    return inside.astype(np.int64)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest kind that holds them."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all rows, exact; a shorter vector ends in zeros."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]

    def most(values: np.ndarray) -> int:
        return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0

    bound = width * most(left) * most(right)
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def best(places: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` highest scores; among equal ones the earlier places."""
    if len(places) <= most:
        return places
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = places[scores > least]
    return np.concatenate([above, places[scores == least][: most - len(above)]])


def keys(row: int, scores: np.ndarray, other: int, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
    """Keys whose byte order is anchor, score downwards, own label first, id with null last."""
    out = np.zeros(len(scores), dtype=_KEY)
    out["row"] = row
    out["score"] = ~(scores.astype(np.int64).view(np.uint64) ^ _TOP)
    out["other"] = other
    out["no_id"] = no_id
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ _TOP
    # As plain bytes: numpy turns numbers to the machine's byte order when arrays are joined.
    return out.view(_BYTES)


def unpacked(key: bytes) -> tuple[int, int, int, int | None]:
    """``(row, score, other, id)`` of a key."""
    row, score = int.from_bytes(key[:8]), (1 << 63) - 1 - int.from_bytes(key[8:16])
    return row, score, key[16], None if key[17] else int.from_bytes(key[18:]) - (1 << 63)


def _binary(parts: np.ndarray) -> pa.Array:
    offsets = np.arange(len(parts) + 1, dtype=np.int32) * parts.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(parts.tobytes())])


def _listed(values: pa.Array) -> pa.Array:
    """All values as the one entry of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@dataclass
class Rows:
    """A block of rows in the order of their ids, null ids last."""

    numbers: np.ndarray
    ids: np.ndarray
    no_id: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.ids, self.no_id))
        for name in ("numbers", "ids", "no_id", "labels", "vectors"):
            setattr(self, name, getattr(self, name)[order])
        self.by_label = np.argsort(self.labels, kind="stable")
        self.sorted_labels = self.labels[self.by_label]

    def of_label(self, label: int) -> np.ndarray:
        return self.by_label[slice(*np.searchsorted(self.sorted_labels, [label, label + 1]))]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    missing = np.asarray(column.is_null())
    return np.asarray(column.fill_null(_NO_ID), dtype=np.int64), missing


def row_blocks(vectors: DataFrame, id: str, vector: str, label: str, anchor: Column) -> DataFrame:
    """Rows that take part, with a number each, in blocks of about ``BLOCK_CELLS`` components."""
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(plain(id)).cast("long").alias("id"), F.col(plain(label)).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(plain(vector)).cast("array<double>").alias("vector"),
    ).filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)

    def block(first: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, labels, anchors, lists = (table.column(k).combine_chunks() for k in range(4))
        sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        width = int(sizes.max(initial=0))
        cells = np.zeros((len(sizes), width), dtype=np.int64)
        cells[np.arange(width) < sizes[:, None]] = whole_numbers(np.asarray(lists.flatten()))
        cells = narrow(cells)
        return pa.RecordBatch.from_arrays([
            pa.array([first], pa.int64()), _listed(ids), _listed(labels),
            _listed(pa.array(np.flatnonzero(np.asarray(anchors)), pa.int32())),
            pa.array([width], pa.int32()), pa.array([cells.dtype.str]), pa.array([cells.tobytes()], pa.binary()),
        ], names=["first", "ids", "labels", "anchors", "width", "kind", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, rows, widest = TaskContext.get().partitionId() << 40, [], 0, 1
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(3)), dtype=np.int64)
            low = 0
            while low < len(sizes):
                # As many rows as keep a block of the widest so far within bounds, one at least.
                wide = np.maximum(np.maximum.accumulate(sizes[low:]), widest)
                fits = wide * (rows + np.arange(1, len(wide) + 1)) <= BLOCK_CELLS
                take = int(fits.argmin()) if not fits.all() else len(wide)
                if not take and not rows:
                    take = 1
                if take:
                    parts.append(batch.slice(low, take))
                    rows, widest, low = rows + take, int(wide[take - 1]), low + take
                if low < len(sizes):
                    yield block(first, parts)
                    first, parts, rows, widest = first + rows, [], 0, 1
        if parts:
            yield block(first, parts)

    return written(rows.select("id", "label", "anchor", "vector").mapInArrow(packed, BLOCK), "vector-blocks")


def _opened(batch: pa.RecordBatch, at: int) -> Rows:
    def field(name: str):
        return batch.column(batch.schema.get_field_index(name))[at]

    ids, no_id = _ids(field("ids").values)
    labels = np.asarray(field("labels").values, dtype=np.int64)
    cells = np.frombuffer(field("data").as_py(), dtype=field("kind").as_py()).reshape(len(labels), field("width").as_py())
    return Rows(field("first").as_py() + np.arange(len(labels)), ids, no_id, labels, cells)


def _anchors(blocks: DataFrame) -> DataFrame:
    """``(row, id, label, vector)`` of the rows that are anchors."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                def field(name: str):
                    return batch.column(batch.schema.get_field_index(name))[at]

                places = np.asarray(field("anchors").values, dtype=np.int64)
                ids, labels = field("ids").values, field("labels").values
                width = field("width").as_py()
                cells = np.frombuffer(field("data").as_py(), dtype=field("kind").as_py()).reshape(len(labels), width)
                yield pa.RecordBatch.from_arrays([
                    pa.array(field("first").as_py() + places, pa.int64()), ids.take(pa.array(places)), labels.take(pa.array(places)),
                    pa.array([cells[p].astype("<i8").tobytes() for p in places], pa.binary()),
                ], names=["row", "id", "label", "vector"])

    return written(blocks.mapInArrow(picked, ANCHOR), "anchors")


def _meet(
    blocks: DataFrame, anchors: DataFrame, buckets: int, scores: bool,
    made: Callable[[Rows, Rows, list[list[int]], np.ndarray], Iterator[tuple[np.ndarray, int | None]]],
) -> DataFrame:
    """``made`` of every block of rows and every block of anchors, as ``FOUND`` rows."""
    if not scores:
        anchors = anchors.withColumn("scores", F.array().cast("array<long>"))
    grouped = anchors.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    member = F.struct("row", "id", "label", "scores", "vector")
    packed = written(grouped.groupBy("bucket").agg(F.collect_list(member).alias("members")), "anchor-blocks")
    size = anchors.agg(F.coalesce(F.sum(F.length("vector") + F.lit(64)), F.lit(0))).first()[0]
    spread = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    if size <= MOST_BROADCAST:
        joined = spread.join(F.broadcast(packed), "bucket")
    else:
        share = F.pmod(F.xxhash64("first"), F.lit(SHARES)).cast("int")
        copies = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        joined = spread.withColumn("share", share).join(copies, ["bucket", "share"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                def field(name: str):
                    return batch.column(batch.schema.get_field_index(name))[at]

                rows = _opened(batch, at)
                members = field("members").values
                vectors = [np.frombuffer(v.as_py(), dtype="<i8") for v in members.field("vector")]
                width = max(map(len, vectors), default=0)
                cells = np.array([np.pad(v, (0, width - len(v))) for v in vectors]).reshape(len(vectors), width)
                numbers, labels = (np.asarray(members.field(n), dtype=np.int64) for n in ("row", "label"))
                ids, windows = members.field("id"), members.field("scores").to_pylist()
                for low in range(0, len(numbers), AT_ONCE):
                    product = products(cells[low: low + AT_ONCE], rows.vectors)
                    parts, owner = [], []
                    for k in range(len(product)):
                        a = low + k
                        found = made(rows, int(numbers[a]), int(labels[a]), windows[a], product[k])
                        parts.append(found)
                        owner.append(np.full(len(found), a))
                    whole = np.concatenate(parts)
                    yield pa.RecordBatch.from_arrays(
                        [_binary(whole), ids.take(pa.array(np.concatenate(owner)))], names=["key", "anchor_id"]
                    )

    return joined.select("first", "ids", "labels", "width", "kind", "data", "members").mapInArrow(scored, FOUND)


def _sorted(found: DataFrame) -> DataFrame:
    """Secondary sort: partitions by anchor, inside them by the whole key."""
    return found.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def _positives(blocks: DataFrame, anchors: DataFrame, buckets: int, rule: Rule) -> DataFrame:
    """``POSITIVES``: the first rows of each anchor's label, without itself."""

    def nearest(rows: Rows, row: int, label: int, _: list[int], scores: np.ndarray) -> np.ndarray:
        places = rows.of_label(label)
        places = places[rows.numbers[places] != row]
        places = best(places, scores[places], rule.positives)
        return keys(row, scores[places], 0, rows.ids[places], rows.no_id[places])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = None, 0
        for batch in batches:
            out, kept = [], []
            for at, key in enumerate(batch.column(0)):
                row, score, _, id = unpacked(key.as_py())
                if row != current:
                    current, count = row, 0
                if count < rule.positives:
                    out.append((row, id, score))
                    kept.append(at)
                    count += 1
            places = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int64()), batch.column(1).take(places),
                pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
                batch.column(0).take(places),
            ], names=["row", "anchor_id", "positive_id", "score", "key"])

    found = _sorted(_meet(blocks, anchors, buckets, False, nearest))
    return written(found.mapInArrow(firsts, POSITIVES), "positives")


def _negatives(blocks: DataFrame, anchors: DataFrame, buckets: int, rule: Rule) -> DataFrame:
    def below(rows: Rows, row: int, label: int, positives: list[int], scores: np.ndarray) -> np.ndarray:
        # A window below zero is empty: its least score is above its greatest.
        windows = {rule.window(p) for p in positives}
        windows = [(low, high) for low, high in windows if low <= high]
        if not windows:
            return np.zeros(0, dtype=_BYTES)
        inside = (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows))
        inside[rows.of_label(label)] = False
        near = np.flatnonzero(inside)
        values = scores[near]
        chosen = []
        for low, high in windows:
            fits = (values >= low) & (values <= high)
            chosen.append(best(near[fits], values[fits], rule.negatives))
        places = np.unique(np.concatenate(chosen))
        return keys(row, scores[places], 1, rows.ids[places], rows.no_id[places])

    return _meet(blocks, anchors, buckets, True, below)


class Windows:
    """The open windows of the anchor that a sorted run of keys has come to."""

    def __init__(self, rule: Rule):
        self.rule, self.row, self.open = rule, None, []

    def step(self, key: bytes, anchor_id: int | None) -> Iterator[tuple]:
        row, score, other, id = unpacked(key)
        if row != self.row:
            self.row, self.open = row, []
        if not other:
            low, high = self.rule.window(score)
            self.open.append([id, score, low, high, 0])
            return
        for window in self.open:
            positive_id, positive, low, high, rank = window
            if low <= score <= high and rank < self.rule.negatives:
                window[4] = rank + 1
                yield anchor_id, positive_id, rank + 1, id, positive, score


def mine(
    vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    rule: Rule = Rule(),
) -> DataFrame:
    """For each anchor and each of its positives the first negatives of the positive's window.

    ``anchor`` says which rows are anchors. A row's score is its integer inner product with the
    anchor, higher ones come first, ties by id (null ids last). Rows with a null label, a null vector
    or a null or non-finite component take no part; a null ``anchor`` is false. Vectors of unequal
    lengths are compared as if the shorter ended in zeros, an empty one scores 0. Rows are told
    apart by place, so repeated rows (also of an anchor) count as often as they are there, and a
    repeated anchor has its results once for each time. A window of a negative positive score is
    empty. Anchors without positives and positives without negatives have no rows; an
    empty table gives none. Scores are exact while they fit into a long. Other columns are not read.
    """
    if not isinstance(label, str):
        vectors = vectors.select(F.col(plain(id)).alias("id"), F.col(plain(vector)).alias("vector"),
                                 label.alias("label"), anchor.alias("anchor"))
        id, vector, label, anchor = "id", "vector", "label", F.col("anchor")
    blocks = row_blocks(vectors, id, vector, label, anchor)
    anchors = _anchors(blocks)
    buckets = max(1, -(-anchors.count() // ANCHORS))
    positives = _positives(blocks, anchors, buckets, rule)
    scores = positives.groupBy("row").agg(F.collect_set("score").alias("scores"))
    negatives = _negatives(blocks, anchors.join(scores, "row"), buckets, rule)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Windows(rule)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        for batch in batches:
            out = [
                row for key, anchor_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for row in state.step(key, anchor_id)
            ]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return _sorted(positives.select("key", "anchor_id").unionByName(negatives)).mapInArrow(windows, RESULT)
