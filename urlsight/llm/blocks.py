"""Documents in compressed blocks, and questions about keys that blocks put to each other.

De-duplication inside texts asks the same kind of question twice: a block of documents has
millions of hashes, and for each it must learn whether other blocks have it too. Keys are
combined within a block first, so that copies cost one key a block, then sent in sorted, packed
lists to the bucket of their range, and the answers come back in the order of the lists.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.llm import arrays
from urlsight.llm.stored import plain, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)

#: Bytes of text in a block (one longer text makes a longer block), and behind a bucket of keys.
#: For much more data than one bucket a core, larger blocks keep the packed lists long.
BLOCK_BYTES = 1 << 21
BUCKET_BYTES = 12 << 20


@dataclass
class Block:
    number: int
    ids: list
    texts: arrays.Texts


def stored_blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """``(block, ids, bounds, size, data)``: neighbouring documents, compressed, computed once."""
    source = docs.select(F.col(plain(id)).cast("long").alias("id"), F.col(plain(text)).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            for low, high, texts in arrays.runs(batch.column(1), most):
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()),
                    pa.array([batch.column(0).slice(low, high - low).to_pylist()], pa.list_(pa.int64())),
                    pa.array([texts.bounds.astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([texts.size], pa.int64()),
                    pa.array([pack.compress(texts.data[: texts.size].tobytes())], pa.binary()),
                ], names=["block", "ids", "bounds", "size", "data"])
                number += 1

    return stored(source.mapInArrow(cut, "block long, ids array<long>, bounds array<long>, size long, data binary"))


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    """The blocks in a batch of rows, one at a time."""
    unpack = zstandard.ZstdDecompressor()
    names = batch.schema.names
    block, ids, bounds, size, data = (batch.column(names.index(n)) for n in ("block", "ids", "bounds", "size", "data"))
    for row in range(batch.num_rows):
        whole = size[row].as_py()
        raw = unpack.decompress(data[row].as_py(), max_output_size=max(whole, 1)) if whole else b""
        flat = np.concatenate([np.frombuffer(raw, dtype=np.uint8), np.zeros(arrays.PAD, np.uint8)])
        limits = np.array(bounds[row].values, dtype=np.int64)
        yield row, Block(block[row].as_py(), ids[row].as_py(), arrays.Texts(flat, limits))


def bucket_count(blocks: DataFrame, most: int = BUCKET_BYTES) -> int:
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(1, math.ceil(total / most))


def planes(values: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second bytes and so on, which compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def numbers(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(data, dtype=np.uint8).reshape(width, len(data) // width)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys are in the order of their buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def exchange(
    asking: DataFrame,
    keys_of: Callable[[Block, dict], tuple[np.ndarray, np.ndarray]],
    answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    buckets: int,
    key_kind: str = "<u8",
    value_kind: str = "<u8",
) -> DataFrame:
    """``(block, answers)``: for each block its keys' answers, one byte a key, in key order.

    ``keys_of(block, earlier answers)`` gives sorted distinct 64-bit keys and a value for each;
    ``answer(keys, values, block numbers)`` gives a byte for each key of a whole bucket. With a
    32-bit ``key_kind`` keys travel without the bits that the bucket tells and without their
    last ones; then different keys can, rarely, look equal.
    """
    short = np.dtype(key_kind).itemsize == 4

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in opened(batch):
                keys, values = keys_of(block, answers_in(batch, row))
                where = bucket_of(keys, buckets)
                edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(keys) else [0]
                spans = list(zip(edges[:-1], edges[1:]))
                sent = shortened(keys, buckets) if short else keys
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(where[a]) for a, _ in spans], pa.int64()),
                    pa.array([block.number] * len(spans), pa.int64()),
                    pa.array([planes(sent[a:b].astype(key_kind)) for a, b in spans], pa.binary()),
                    pa.array([planes(values[a:b].astype(value_kind)) for a, b in spans], pa.binary()),
                ], names=["bucket", "block", "keys", "values"])

    def answered(table: pa.Table) -> pa.Table:
        keys = [numbers(k.as_py(), key_kind) for k in table["keys"]]
        values = [numbers(v.as_py(), value_kind) for v in table["values"]]
        sizes = np.array([len(k) for k in keys])
        owner = np.repeat(np.array(table["block"]), sizes)
        found = answer(np.concatenate(keys), np.concatenate(values), owner).astype(np.uint8)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({
            "block": table["block"], "bucket": table["bucket"],
            "answer": pa.array([found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
        })

    sent = asking.mapInArrow(asked, "bucket long, block long, keys binary, values binary")
    found = sent.groupBy("bucket").applyInArrow(answered, "block long, bucket long, answer binary")
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))


def shortened(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits of each key that follow those its bucket tells."""
    told = np.uint64(buckets.bit_length() - 1)
    return ((keys << told) >> np.uint64(32)).astype(np.uint32)


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with the answers to their keys, each as one binary column ``answers_<name>``.

    Answers are stored, blocks are joined with them anew wherever they are needed: a shuffle of
    the compressed blocks takes no more room than a copy of them would.
    """
    for name, found in answers.items():
        column = F.col("answers.answer").alias(f"answers_{name}")
        blocks = blocks.join(found.select("block", column), "block", "left")
    return blocks


def answers_in(batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
    """The answer columns of a row, joined up again."""
    out = {}
    for i, name in enumerate(batch.schema.names):
        if name.startswith("answers"):
            parts = batch.column(i)[row].as_py() or []
            out[name] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return out

