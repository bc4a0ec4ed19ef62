"""Packs token pieces into sequences by hierarchical best fit.

Every task packs its pieces into bins by best fit, largest first. Bins that are nearly full
are done; the others go up the tree as items of their own, where groups of them are packed
again, round after round, until they fit one group or no longer get fewer.
"""

from __future__ import annotations

import json
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.llm.stored import by_place, extended, plain, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END = 0
#: Free tokens with which a bin counts as nearly full, as a share of the capacity.
NEARLY_FULL = 1 / 256
#: Underfull bins that one task packs in a round.
GROUP_BINS = 100_000
MOST_ROUNDS = 20
#: Characters of a run that is left to the slower library; rows that are tokenised together.
LONG = 4000
ROWS = 500


# Fixed value: how a byte-level tokenizer splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts by a tokenizer file of the ``tokenizers`` library.

    A plain byte-level file whose ids follow the order of its merges is run by ``tiktoken``, which
    gives the same ids in a fraction of the time. Other files, texts with a run of ``LONG``
    characters without a blank or of blanks alone, and texts that contain an added token go through
    ``tokenizers`` itself; an added token in a text gets its own id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.slow = Tokenizer.from_file(path)
        self.added = [token["content"] for token in parts["added_tokens"]]
        self.fast = None
        ranks = byte_ranks(parts)
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, followed by ``END``."""
        if self.fast is None or has_long_run(text) or any(token in text for token in self.added):
            found = np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            found = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.append(found.astype("<u4", copy=False), np.array([END], dtype="<u4"))


def has_long_run(text: str) -> bool:
    return len(text) >= LONG and (max(map(len, text.split(" "))) >= LONG or " " * LONG in text)


def byte_ranks(parts: dict) -> dict[bytes, int] | None:
    """Ids by bytes if the file is plain byte-level BPE with ids in the order of its merges."""
    model, split = parts["model"], parts["pre_tokenizer"] or {}
    plain_file = (
        model["type"] == "BPE" and parts["normalizer"] is None and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space") and split.get("use_regex")
        and not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    )
    if not plain_file:
        return None
    # A byte is written as the character it prints as, or as the next one from 256 on.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {token["content"] for token in parts["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): k for word, k in model["vocab"].items() if word not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][left + right] for left, right in pairs]
    in_order = order == sorted(order) and len(set(order)) == len(ranks) - 256
    return ranks if in_order and all(bytes([b]) in ranks for b in range(256)) else None


def pieces(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, with_ids: bool = True, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, *keep, piece, start, length, ids_crc32[, ids])`` of the token ids of every text.

    Each text ends with ``END``; a null text is an empty one. A text of more than ``capacity``
    ids is cut into pieces of that size, counted from its end, so only the first can be shorter.
    """
    carried = [id, *keep]
    source = by_place(docs, carried, __text=F.coalesce(F.col(plain(text)), F.lit("")).cast("binary"))
    made = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    out = extended(source, made, without=("__text",))
    names = out.names

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for low in range(0, batch.num_rows, ROWS):
                rows = batch.slice(low, ROWS)
                owner, piece, start, length, check, ids = [], [], [], [], [], []
                for k, text in enumerate(rows.column(at)):
                    found = encoder.ids(text.as_py().decode("utf-8", "replace"))
                    count = len(found)
                    edges = [0, *range(count % capacity or capacity, count + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = found[a:b]
                        owner.append(k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        check.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part.view("<i4"))
                columns = [rows.column(i).take(pa.array(owner, pa.int64())) for i in range(rows.num_columns) if i != at]
                columns += [
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(check, pa.int64()),
                ]
                columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(cut_up, out).toDF(*carried, *names[len(carried):])


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: largest first, fullest bin that fits.

    Open bins lie in stacks by their free room; a bit mask of the stacks that are not empty
    finds the least room that is enough.
    """
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            target = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, target, used = capacity, used, used + 1
        bins[item], offsets[item] = target, capacity - room
        stacks[room - size].append(target)
        rooms |= 1 << (room - size)
    return bins, offsets, used


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY, group: int = GROUP_BINS) -> DataFrame:
    """All columns of ``items`` plus ``sequence_id`` and ``offset``; sequences have no gaps.

    ``items`` must be stored (bins are numbered by partition) and hold sizes from 0 to
    ``capacity``. Columns named like a new one are replaced; an empty table stays empty.
    """
    room = max(1, int(capacity * NEARLY_FULL))
    carried = [c for c in items.columns if c not in ("sequence_id", "offset")]
    source = by_place(items, carried, __task=F.spark_partition_id())
    size = f"__{carried.index(size)}"
    placed = stored(source.mapInArrow(
        _leaves(size, capacity), extended(source, "__bin long, __at long", without=("__task",))
    ))
    bins = stored(placed.groupBy(F.col("__bin").alias("bin")).agg(F.sum(size).alias("fill")))
    leaf = F.array(F.struct(F.col("bin").alias("leaf"), F.lit(0).cast("long").alias("shift")))
    full = F.col("fill") > capacity - room
    done = [bins.filter(full).withColumn("leaves", leaf)]
    open_bins = stored(bins.filter(~full).withColumn("leaves", leaf))
    left = open_bins.count()
    for number in range(MOST_ROUNDS):
        if left <= 1:
            break
        groups = math.ceil(left / group)
        dealt = open_bins.repartition(groups, F.xxhash64("bin", F.lit(number)))
        merged = stored(dealt.mapInArrow(_merged(capacity), open_bins.schema))
        done.append(merged.filter(full))
        open_bins = stored(merged.filter(~full))
        before, left = left, open_bins.count()
        if groups == 1 or left > 0.98 * before:
            break
    sequences = open_bins
    for part in done:
        sequences = sequences.unionByName(part)
    where = sequences.select(F.col("bin").alias("sequence_id"), F.explode("leaves").alias("l")).select(
        F.col("l.leaf").alias("__bin"), "sequence_id", F.col("l.shift").alias("__shift")
    )
    return placed.join(where, "__bin").select(
        *[F.col(f"__{k}").alias(c) for k, c in enumerate(carried)],
        "sequence_id", (F.col("__at") + F.col("__shift")).alias("offset"),
    )


def assemble(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of packed pieces that carry their ids: one row for each sequence.

    A sequence holds at most its capacity of ids, so a row is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda part: part["ids"])).alias("ids")
    )


def _leaves(size: str, capacity: int):
    """Best fit of the items of a task; a bin's number holds the task's and the batch's."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("__task")
            task = batch.column(at)[0].as_py()
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False)
            bins, offsets, count = best_fit(sizes, capacity)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array((task << 40) + used + bins), pa.array(offsets)],
                names=[*[batch.schema.names[i] for i in kept], "__bin", "__at"],
            )
            used += count

    return packed


def _merged(capacity: int):
    """Best fit of underfull bins; the fullest bin of a new one gives it its number."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks().sort_by([("fill", "descending"), ("bin", "ascending")])
        fill = table["fill"].to_numpy()
        bins, offsets, count = best_fit(fill, capacity)
        order = np.lexsort((offsets, bins))
        heads = order[np.searchsorted(bins[order], np.arange(count))]
        leaves = table["leaves"].combine_chunks().take(pa.array(order))
        sizes = np.diff(leaves.offsets.to_numpy())
        flat = leaves.flatten()
        shift = flat.field("shift").to_numpy() + np.repeat(offsets[order], sizes)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(bins[order], weights=sizes, minlength=count))])
        made = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)),
            pa.StructArray.from_arrays([flat.field("leaf"), pa.array(shift)], names=["leaf", "shift"]),
        )
        total = np.bincount(bins, weights=fill, minlength=count).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [table["bin"].combine_chunks().take(pa.array(heads)), pa.array(total), made], names=["bin", "fill", "leaves"]
        )

    return packed
