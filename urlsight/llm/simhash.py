"""Near-duplicates by SimHash: a self-join of the binary trie of all fingerprints.

The trie is cut into blocks, subtries of at most ``BLOCK`` fingerprints. From the root on,
pairs of nodes go down together; a pair carries the bits in which its prefixes differ and is
dropped once they exceed the error budget. The pairs of blocks that remain are joined in
tasks, which go on down both subtries in the same way. A task returns a spanning forest of
its links, not all of them; components over those forests are the classes.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.llm import arrays
from urlsight.llm.components import components
from urlsight.llm.stored import by_place, extended, found_again, plain, stored, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)

WORDS = 3
DISTANCE = 2
SEED = 42
BITS = 64
#: Fingerprints in a block of the trie, and bits that a node is cut by in one round.
BLOCK = 2048
STEP = 4
#: Bytes of a text that are hashed at once.
SLICE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Pairs of nodes that go down together in a task.
FRONTIER = 1 << 15


def slices(text: bytes, most: int = SLICE) -> Iterator[bytes]:
    """A long text in slices that cut no word."""
    low = 0
    while len(text) - low > most:
        blank = BLANK.search(text, low + most)
        high = blank.end() if blank else len(text)
        yield text[low:high]
        low = high
    yield text[low:]


def simhash(text: bytes, words: int = WORDS) -> int:
    """The bits set in over half of the shingle hashes; 0 for a text without words.

    Works on a slice of the text at a time, so that a long one takes little more than its size.
    """
    votes, total, open_ = np.zeros(BITS, dtype=np.int64), 0, []
    for part in slices(text):
        found = open_ + part.lower().split()
        hashes = shingle_hashes(found, words)
        votes += set_bits(hashes)
        total += len(hashes)
        # The last words open shingles that end in the next slice.
        open_ = found[max(0, len(found) - words + 1):] if words > 1 else []
    if not total and open_:
        votes, total = set_bits(np.array([xxhash.xxh64_intdigest(b" ".join(open_), SEED)], dtype="<u8")), 1
    return int(sum(1 << k for k in np.flatnonzero(2 * votes > total).tolist())) if total else 0


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` words, the words joined by blanks; fewer words have none."""
    if len(found) < words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())], dtype="<u8")


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    votes = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low: low + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return votes


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """All columns of ``docs`` but the text, plus the fingerprint as a signed 64-bit number.

    A null, empty or blank text has fingerprint 0. ``name`` replaces a column of that name.
    """
    carried = [c for c in docs.columns if c not in {name, text}]
    source = by_place(docs, carried, __text=F.col(plain(text)).cast("binary"))
    out = extended(source, "__print long", without=("__text",))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            marks = np.array([simhash(t.as_py() or b"", words) for t in batch.column(at)], dtype=np.uint64)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(marks.view(np.int64))],
                names=[*[batch.schema.names[i] for i in kept], "__print"],
            )

    return source.mapInArrow(printed, out).toDF(*carried, name)


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def cluster(prints: DataFrame, id: str = "doc_id", name: str = "fingerprint", distance: int = DISTANCE) -> DataFrame:
    """Rows of ``prints`` plus ``component_id``, the least id that links of ``distance`` bits reach.

    Equal fingerprints are one node of the graph, so copies cost one row. Repeated rows stay
    repeated; a null id gets its class but is never the least (a class of null ids has null).
    An empty table gives an empty result. ``prints`` should be stored: it is read twice.
    """
    nodes = stored(prints.groupBy(F.col(plain(name)).alias("print")).agg(F.min(plain(id)).alias("least")))
    roots = components(links(nodes.select("print"), distance))
    classed = stored(
        nodes.join(roots.withColumnRenamed("node", "print"), "print", "left")
        .select("print", F.coalesce("root", "print").alias("root"), "least")
    )
    lows = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(classed.select("print", "root").join(lows, "root").select(F.col("print").alias("__print"), "component_id"))
    rows = prints.drop("component_id")
    return rows.join(found, F.col(plain(name)) == F.col("__print"), "left").drop("__print")


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that join all pairs within ``distance`` bits.

    Two fingerprints are connected by the result exactly if a chain of such pairs connects them.
    """
    blocks = stored(cut_trie(nodes, block))
    pairs = block_pairs(blocks, distance)
    left = blocks.select(F.col("depth").alias("da"), F.col("prefix").alias("pa"), F.col("members").alias("left"))
    right = blocks.select(F.col("depth").alias("db"), F.col("prefix").alias("pb"), F.col("members").alias("right"))
    work = (
        pairs.join(left, ["da", "pa"]).join(right, ["db", "pb"])
        .select("da", "db", "differing", "left", "right")
    )

    def descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for da, db, differing, left, right in zip(*[batch.column(i) for i in range(5)]):
                a = np.array(left.values, dtype=np.int64).view(np.uint64)
                b = np.array(right.values, dtype=np.int64).view(np.uint64)
                a, b = np.sort(a), np.sort(b)
                depth = min(da.as_py(), db.as_py())
                x, y = descend(a, b, depth, differing.as_py(), distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"]
                )

    return work.mapInArrow(descended, "a long, b long")


def _top(column: str, bits: int) -> Column:
    """The first bits of a fingerprint, the rest zero."""
    mask = -1 << (BITS - bits) if bits else 0
    return F.col(column).bitwiseAND(F.lit(mask).cast("long"))


def cut_trie(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(depth, prefix, members)``: subtries of at most ``block`` fingerprints.

    Level by level the counts of all nodes tell which are small enough; a crowded part of the
    trie is cut deeper than the rest, so close fingerprints do not pile up in one block. What a
    level leaves is written as a table: a checkpoint would keep the filters of all levels before
    it as constraints, which the optimizer multiplies from level to level.
    """
    rest, parts = nodes, []
    for depth in range(0, BITS + STEP, STEP):
        sizes = written(rest.groupBy(_top("print", depth).alias("prefix")).count(), "trie-sizes")
        large = sizes.filter(F.col("count") > block).select("prefix")
        placed = rest.withColumn("prefix", _top("print", depth))
        small = placed.join(sizes.filter(F.col("count") <= block).select("prefix"), "prefix")
        parts.append(
            small.groupBy("prefix").agg(F.collect_list("print").alias("members"))
            .select(F.lit(depth).alias("depth"), "prefix", "members")
        )
        if large.isEmpty():
            break
        rest = written(placed.join(large, "prefix").drop("prefix"), "trie-rest")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def block_pairs(blocks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs of blocks ``(da, pa, db, pb, differing)`` that the error budget leaves.

    The frontier starts with the pair of the root with itself. In a round both nodes of a
    pair step down ``STEP`` bits; a block that is reached stays where it is. The bits that
    count are those both prefixes have.
    """
    spark = blocks.sparkSession
    ends = blocks.select("depth", "prefix")
    deepest = ends.agg(F.max("depth")).first()[0] or 0
    pairs = spark.createDataFrame([(0, 0, 0, 0)], "da int, pa long, db int, pb long")
    for depth in range(STEP, deepest + STEP, STEP):
        above = _top("prefix", depth - STEP)
        children = written(
            ends.filter(F.col("depth") >= depth)
            .select(above.alias("up"), F.lit(depth).alias("d"), _top("prefix", depth).alias("p"))
            .unionByName(
                ends.filter(F.col("depth") < depth)
                .select(F.col("prefix").alias("up"), F.col("depth").alias("d"), F.col("prefix").alias("p"))
            )
            .select("up", "d", "p", F.least("d", F.lit(depth - STEP)).alias("ud")).distinct(),
            "trie-children",
        )
        first = children.select(F.col("ud").alias("da"), F.col("up").alias("pa"), F.col("d").alias("ca"), F.col("p").alias("xa"))
        second = children.select(F.col("ud").alias("db"), F.col("up").alias("pb"), F.col("d").alias("cb"), F.col("p").alias("xb"))
        pairs = written(
            pairs.join(first, ["da", "pa"]).join(second, ["db", "pb"])
            .select(F.col("ca").alias("da"), F.col("xa").alias("pa"), F.col("cb").alias("db"), F.col("xb").alias("pb"))
            .filter(_ordered()).filter(_differing() <= distance)
            .distinct(),
            "trie-pairs",
        )
    return pairs.withColumn("differing", _differing())


def _ordered() -> Column:
    """Of a pair and its mirror image, one."""
    return (F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("da") <= F.col("db")))


def _differing() -> Column:
    """Bits that differ among those both prefixes have."""
    return F.expr("if(least(da, db) = 0, 0, bit_count(shiftrightunsigned(pa ^ pb, 64 - least(da, db))))")


class Classes:
    """Which of some numbered things are connected so far; a label is the least of its class."""

    def __init__(self, count: int):
        self.label = np.arange(count)
        self.breaks = np.arange(count + 1)

    def connect(self, left: np.ndarray, right: np.ndarray) -> None:
        label = self.label
        while (label[left] != label[right]).any():
            low = np.minimum(label[left], label[right])
            np.minimum.at(label, label[left], low)
            np.minimum.at(label, label[right], low)
            while (label[label] != label).any():
                label = label[label]
        self.label = label
        self.breaks = np.concatenate([[0], np.cumsum(np.concatenate([[True], label[1:] != label[:-1]]))])

    def one(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether all from ``low`` to before ``high`` are in one class."""
        return self.breaks[high] == self.breaks[low + 1]


def descend(a: np.ndarray, b: np.ndarray, depth: int, differing: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of two sorted subtries that are within ``distance``.

    A node is a range of the sorted array. Pairs of nodes go down both subtries together, some
    ``FRONTIER`` at a time, the deepest first. A pair whose prefixes differ in more bits than
    allowed is dropped, and so is one whose fingerprints are all connected already, so a crowd
    of close fingerprints costs little more than its size. Nodes with one fingerprint each are
    compared at once. The links join every fingerprint to the least of its class.
    """
    own = len(a) == len(b) and bool((a == b).all())
    values = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    classes = Classes(len(values))
    stack = [(depth, *(np.array([v]) for v in (0, len(a), 0, len(b), differing)))]
    while stack:
        depth, *pairs = stack.pop()
        if len(pairs[0]) > FRONTIER:
            half = len(pairs[0]) // 2
            stack += [(depth, *(v[half:] for v in pairs)), (depth, *(v[:half] for v in pairs))]
            continue
        lo_a, hi_a, lo_b, hi_b, cost = pairs
        apart = ~(
            classes.one(lo_a, hi_a) & classes.one(lo_b + shift, hi_b + shift)
            & (classes.label[lo_a] == classes.label[lo_b + shift])
        )
        lo_a, hi_a, lo_b, hi_b, cost = (v[apart] for v in pairs)
        single = ((hi_a - lo_a == 1) & (hi_b - lo_b == 1)) | (depth >= BITS)
        if single.any():
            x, y = lo_a[single], lo_b[single]
            near = np.bitwise_count(a[x] ^ b[y]) <= distance
            classes.connect(x[near], y[near] + shift)
            lo_a, hi_a, lo_b, hi_b, cost = (v[~single] for v in (lo_a, hi_a, lo_b, hi_b, cost))
        if not len(cost):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        mid_a, mid_b = _middle(a, lo_a, hi_a, bit), _middle(b, lo_b, hi_b, bit)
        sides = []
        for low_a, high_a, one in ((lo_a, mid_a, 0), (mid_a, hi_a, 1)):
            for low_b, high_b, other in ((lo_b, mid_b, 0), (mid_b, hi_b, 1)):
                total = cost + (one != other)
                fits = (low_a < high_a) & (low_b < high_b) & (total <= distance)
                if own:
                    fits &= low_a <= low_b
                sides.append([v[fits] for v in (low_a, high_a, low_b, high_b, total)])
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*sides))))
    moved = np.flatnonzero(classes.label != np.arange(len(values)))
    return values[moved], values[classes.label[moved]]


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each range the fingerprints with ``bit`` begin."""
    ones = np.concatenate([[0], np.cumsum((values & bit) != 0)])
    return high - (ones[high] - ones[low])


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each class of near-duplicates: the one with the least id (null ids last).

    Repeated rows count once. All columns of ``docs`` come back. Rows are found again by id
    and a hash of the text, so ids need not be unique.
    """
    key = F.xxhash64(F.col(plain(text)))
    marked = docs.select(F.col(plain(id)).alias("id"), key.alias("key"), F.col(plain(text)).alias("text"))
    prints = stored(fingerprints(marked, "text", "print_of"))
    classes = cluster(prints, "id", "print_of").withColumn("size", F.lit(1))
    order = F.struct(F.col("id").isNull(), "id", "key")
    stays = classes.groupBy(
        F.coalesce("component_id", F.lit(0)).alias("c"), F.col("component_id").isNull().alias("n"),
        F.when(F.col("component_id").isNull(), F.col("print_of")).alias("p"),
    ).agg(F.min(order).alias("stay")).select("stay.id", "stay.key")
    return found_again(docs, stays, id, text)
