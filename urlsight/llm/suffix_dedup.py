"""Removes bytes of texts that lie in a string of 200 bytes that also starts elsewhere.

Only some suffixes are sorted. In every window of 200 bytes the position with the least hash of
16 bytes is sampled, so equal windows sample the same place in them. Neighbouring windows with
the same sample make a segment. Segments are compared by sample and content first: a sample that
occurs once rules its windows out, and equal segments settle theirs. What is left, segments that
share the sample but differ somewhere, is sorted: sampled splitters range-partition the suffixes
by their leading bytes, each range sorts its windows by multikey quicksort and compares
neighbours, and suffixes that begin alike across a boundary are compared across it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.llm import arrays, blocks
from urlsight.llm.blocks import Block
from urlsight.llm.stored import small, stored, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)
cloudpickle.register_pickle_by_value(blocks)

WINDOW = 200
GRAM = 16
SPAN = WINDOW - GRAM + 1
#: Segments in a range.
RANGE_SEGMENTS = 10_000
#: Bytes that one step of the multikey quicksort looks at.
LETTER = 40

SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
SEGMENT = "token long, block long, number int, target boolean, windows int, text binary"

COVERED, COMPARE = 1, 2


class Segments:
    """The segments of a block: ``start`` and ``windows`` count window starts in the block's bytes."""

    def __init__(self, block: Block):
        texts = block.texts
        self.texts = texts
        starts = np.zeros(texts.size + 1, dtype=bool)
        for low, high in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist()):
            starts[low: max(low, high - WINDOW + 1)] = True
        if texts.size < WINDOW or not starts.any():
            self.start = self.windows = self.sample = np.zeros(0, dtype=np.int64)
            self.key = self.content = np.zeros(0, dtype=np.uint64)
            return
        view = texts.eights()
        grams = arrays.joined(view[: texts.size - GRAM + 1], view[8: texts.size - GRAM + 9])
        low_bits = np.uint64(int(texts.size).bit_length())
        marked = ((grams >> low_bits) << low_bits) | np.arange(len(grams), dtype=np.uint64)
        least = lowest(marked, SPAN)
        at = np.flatnonzero(starts[: len(least)])
        sample = (least[at] & np.uint64((1 << int(low_bits)) - 1)).astype(np.int64)
        opens = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.start = at[opens]
        self.windows = np.diff(np.concatenate([opens, [len(at)]]))
        self.sample = sample[opens]
        self.key = arrays.mixed(grams[self.sample])
        spans = arrays.Words(self.start, self.start + self.windows + WINDOW - 1, np.zeros(0, np.int64))
        self.content = arrays.joined(spans.hashes(texts, seed=7), self.windows.astype(np.uint64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the segments by key and content, their pair, the first of each pair, pair sizes."""
        order = np.lexsort((self.content, self.key))
        key, content = self.key[order], self.content[order]
        opens = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])[: len(order)]
        pair = np.cumsum(opens) - 1
        first = order[opens]
        return order, pair, first, np.bincount(pair, minlength=len(first))


def lowest(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every run of ``size`` neighbours, from runs of powers of two."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _pair_keys(block: Block, answers: dict) -> tuple[np.ndarray, np.ndarray]:
    """Keys and contents of a block's distinct segments; the last bit tells if it has one twice."""
    found = Segments(block)
    _, _, first, count = found.pairs()
    return found.key[first], (found.content[first] & ~np.uint64(1)) | (count > 1).astype(np.uint64)


def settle(keys: np.ndarray, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """What is known of each distinct segment of a block from the keys and contents alone.

    Of a segment that occurs again all windows are covered. Segments are to be compared if
    their key has another content and one of the contents occurs once; of equal ones, one is.
    """
    twice, content = (values & np.uint64(1)).astype(np.int64), values >> np.uint64(1)
    order = np.lexsort((owner, content, keys))
    key, content, twice = keys[order], content[order], twice[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_pair = new_key | np.concatenate([[True], content[1:] != content[:-1]])
    pair, group = np.cumsum(new_pair) - 1, np.cumsum(new_key) - 1
    again = (np.bincount(pair, weights=1 + twice) > 1)[pair]
    contents = np.bincount(group, weights=new_pair)[group]
    lonely = np.bincount(group, weights=~again)[group]
    out = np.zeros(len(keys), dtype=np.uint8)
    out[order] = COVERED * again + COMPARE * ((contents > 1) & (lonely > 0) & new_pair)
    return out


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments to compare, with their bytes and the leading bytes of their sampled suffix."""
    for batch in batches:
        for row, block in blocks.opened(batch):
            known = blocks.answers_in(batch, row)["answers_pairs"]
            found = Segments(block)
            _, _, first, _ = found.pairs()
            chosen = np.flatnonzero(known & COMPARE)
            at = first[chosen]
            token = found.texts.eights()[found.sample[at]].astype("<u8").byteswap() if len(at) else np.zeros(0, np.uint64)
            ends = found.start[at] + found.windows[at] + WINDOW - 1
            data = found.texts.data
            yield pa.RecordBatch.from_arrays([
                pa.array((token ^ np.uint64(1 << 63)).view(np.int64)),
                pa.array([block.number] * len(at), pa.int64()),
                pa.array(chosen.astype(np.int32)),
                pa.array((known[chosen] & COVERED) == 0),
                pa.array(found.windows[at].astype(np.int32)),
                pa.array([data[a:b].tobytes() for a, b in zip(found.start[at].tolist(), ends.tolist())], pa.binary()),
            ], names=["token", "block", "number", "target", "windows", "text"])


def repeated_windows(view: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the windows that start at ``starts`` equal another: multikey quicksort.

    A step sorts the windows that are alike so far by their next ``LETTER`` bytes; those that
    differ from all others drop out. At the end neighbours are compared byte by byte.
    """
    active = np.arange(len(starts))
    group = np.zeros(len(starts), dtype=np.int64)
    for depth in range(0, WINDOW, LETTER):
        at = starts[active] + depth
        letter = view[at]
        for more in range(8, LETTER, 8):
            letter = arrays.joined(letter, view[at + more])
        order = np.lexsort((letter, group))
        letter, group, active = letter[order], group[order], active[order]
        opens = np.concatenate([[True], (letter[1:] != letter[:-1]) | (group[1:] != group[:-1])])[: len(active)]
        fresh = np.cumsum(opens) - 1
        shared = np.bincount(fresh, minlength=1)[fresh] > 1
        active, group = active[shared], fresh[shared]
    out = np.zeros(len(starts), dtype=bool)
    if len(active):
        left, right = starts[active[:-1]], starts[active[1:]]
        same = group[1:] == group[:-1]
        for depth in range(0, WINDOW, 8):
            same &= view[left + depth] == view[right + depth]
        out[active[:-1][same]] = True
        out[active[1:][same]] = True
    return out


def _windows_of(batch: pa.Table) -> tuple[arrays.Texts, np.ndarray, np.ndarray]:
    """The texts of segments end to end, and start and segment of each window."""
    _, _, texts = next(arrays.runs(batch["text"], most=1 << 40))
    count = np.array(batch["windows"], dtype=np.int64)
    segment = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    return texts, texts.bounds[:-1][segment] + within, segment


def _sorted_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last repeated window of each target segment of a range, as rows with ``first``.

    Suffixes whose leading bytes are ``split`` go on in other ranges. Their distinct windows
    follow as rows with two hashes; ``lone`` says that the range has the window once.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    texts, starts, segment = _windows_of(table)
    view = texts.eights()
    repeated = repeated_windows(view, starts)
    block, number, target, split = (
        table[name].to_numpy(zero_copy_only=False) for name in ("block", "number", "target", "split")
    )
    within = np.arange(len(segment)) - np.searchsorted(segment, segment)
    first = np.full(len(block), WINDOW, dtype=np.int64)
    last = np.full(len(block), -1, dtype=np.int64)
    np.minimum.at(first, segment[repeated], within[repeated])
    np.maximum.at(last, segment[repeated], within[repeated])
    found = np.flatnonzero(target & (last >= 0))
    yield _rows(block[found], number[found], first=first[found], last=last[found])

    windows = np.flatnonzero(split[segment])
    if not len(windows):
        return
    one = two = np.zeros(len(windows), dtype=np.uint64)
    for depth in range(0, WINDOW, 8):
        letter = view[starts[windows] + depth]
        one, two = arrays.joined(one, letter), arrays.joined(two, ~letter)
    order = np.lexsort((two, one))
    opens = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    chosen = order[opens[: len(order)]]
    at = windows[chosen]
    yield _rows(
        block[segment[at]], number[segment[at]], within=within[at],
        lone=~repeated[at] & target[segment[at]], one=one[chosen].view(np.int64), two=two[chosen].view(np.int64),
    )


RANGE = (
    "block long, number int, first long, last long, within long, lone boolean, one long, two long"
)


def _rows(block: np.ndarray, number: np.ndarray, **known: np.ndarray) -> pa.RecordBatch:
    """Rows of ``RANGE``; columns that are not known are null."""
    kinds = {"lone": pa.bool_()}
    names = [c.split()[0] for c in RANGE.split(", ")]
    given = {"block": block, "number": number.astype(np.int32), **known}
    return pa.RecordBatch.from_arrays([
        pa.array(given[n]) if n in given else pa.nulls(len(block), kinds.get(n, pa.int64())) for n in names
    ], names=names)


def compared(left_over: DataFrame) -> DataFrame:
    """``(block, spans)``: for each target segment with repeated windows the first and the last.

    The suffixes are dealt out by ``repartitionByRange``, which samples its splitters. Suffixes
    with the same leading bytes stay together unless there are more than a range should hold;
    those are split by the block's number, and each range hands on their distinct windows. A
    window that two ranges hand on is repeated wherever it was alone, so a crowd of equal
    windows is one row a range.
    """
    left_over = written(left_over, "segments")
    ranges = max(1, math.ceil(left_over.count() / RANGE_SEGMENTS))
    crowded = stored(
        left_over.groupBy("token").count().filter(F.col("count") > RANGE_SEGMENTS)
        .select("token", F.lit(True).alias("split"))
    )
    marked = left_over.join(small(crowded), "token", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    place = F.when(F.col("split"), F.col("block")).otherwise(F.lit(0))
    dealt = marked.withColumn("place", place).repartitionByRange(ranges, "token", "place")
    local = stored(dealt.mapInArrow(_sorted_ranges, RANGE))
    lone = F.when(F.col("lone"), F.struct("block", "number", "within"))
    across = (
        local.filter("one is not null").groupBy("one", "two")
        .agg(F.count("*").alias("n"), F.collect_list(lone).alias("lone")).filter("n > 1")
        .select(F.explode("lone").alias("w")).select("w.*")
    )
    both = local.filter("one is null").select("block", "number", "first", "last").unionByName(
        across.select("block", "number", F.col("within").alias("first"), F.col("within").alias("last"))
    )
    found = both.groupBy("block", "number").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return stored(found.groupBy("block").agg(F.collect_list(F.struct("number", "first", "last")).alias("spans")))


def cleaned(block: Block, known: np.ndarray, spans: list) -> dict[str, list]:
    """The result columns for the documents of a block."""
    found = Segments(block)
    order, pair, _, _ = found.pairs()
    first = np.full(len(known), -1, dtype=np.int64)
    last = np.full(len(known), -2, dtype=np.int64)
    for span in spans or []:
        first[span["number"]], last[span["number"]] = span["first"], span["last"]
    mine = np.zeros(len(order), dtype=np.int64)
    mine[order] = pair
    whole = (known[mine] & COVERED) > 0
    low = found.start + np.where(whole, 0, first[mine])
    high = found.start + np.where(whole, found.windows - 1, last[mine])
    repeated = high >= low
    bounds = block.texts.bounds
    removed = arrays.merged_within(low[repeated], high[repeated] + WINDOW, bounds)
    out: dict[str, list] = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "spans", "kept")}
    for k, doc in enumerate(block.ids):
        a, b = removed[k]
        text = block.texts.text(k)
        edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
        out["doc_id"].append(doc)
        out["n_bytes"].append(len(text))
        out["n_removed"].append(int((b - a).sum()))
        out["spans"].append([{"start": p, "end": q} for p, q in zip(a.tolist(), b.tolist())])
        out["kept"].append(b"".join(text[p:q] for p, q in zip(edges[::2], edges[1::2])))
    return out


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, spans, kept.

    ``spans`` are the maximal removed runs of bytes, the end exclusive, ``kept`` the other bytes.
    Strings are judged on the input; the same document counts as elsewhere, another place in it.
    A null text is empty and a text under 200 bytes loses nothing. Ids may be null or repeated;
    an empty table gives an empty result.
    """
    cut = blocks.stored_blocks(docs, id, text)
    pairs = blocks.exchange(cut, _pair_keys, settle, blocks.bucket_count(cut))
    known = blocks.with_answers(cut, pairs=stored(pairs))
    told = known.join(compared(known.mapInArrow(_left_over, SEGMENT)), "block", "left")
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
    ])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("spans")
            for row, block in blocks.opened(batch):
                answers = blocks.answers_in(batch, row)["answers_pairs"]
                made = cleaned(block, answers, batch.column(at)[row].as_py())
                yield pa.RecordBatch.from_pydict(made, schema=kinds)

    return told.mapInArrow(finished, SCHEMA)
