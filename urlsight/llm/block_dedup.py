"""Removes passages that a document with a smaller id has, word for word.

Non-overlapping blocks of 25 words of every document are the index, and every run of 25 words
is a probe. A repeat of 50 words or more holds a whole block of the other document, so windows
of 50 words without a hit can't be repeats. Hits are extended: the windows around them look up
the least id that has the same 50 words, and the union of the windows with a smaller one is the
maximal exact repeat.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from urlsight.llm import arrays, blocks
from urlsight.llm.blocks import Block
from urlsight.llm.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)
cloudpickle.register_pickle_by_value(blocks)

WINDOW = 50
ANCHOR = 25
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"

ALIGNED, LOCAL = 1, 2


class Runs:
    """The words of a block, and hashes of runs of them that stay within a document."""

    def __init__(self, block: Block):
        self.texts = block.texts
        self.words = block.texts.words()
        self.hashes = self.words.hashes(block.texts)
        sizes = np.diff(self.words.first)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.owner)) - self.words.first[:-1][self.owner]
        self.left = sizes[self.owner] - self.place

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``size`` words start, and their hashes."""
        starts = np.flatnonzero(self.left >= size)
        return starts, arrays.rolling(self.hashes, size)[starts]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the group of each key, and the sizes of groups."""
    distinct, group, count = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, group, count


def probes(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of probes, the group of each, distinct probes, and for these: has a block, hits here."""
    starts, hashes = runs.of(ANCHOR)
    distinct, group, count = grouped(hashes)
    blocks_in = np.bincount(group, weights=runs.place[starts] % ANCHOR == 0, minlength=len(distinct))
    flags = ALIGNED * (blocks_in > 0) + LOCAL * ((blocks_in > 0) & (count > 1))
    return starts, group, distinct, flags.astype(np.uint8)


def hits(keys: np.ndarray, flags: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Probes that meet a block of another document block, or blocks that another one's probe meets."""
    _, group, count = grouped(keys)
    aligned = (flags & ALIGNED) > 0
    indexed = np.bincount(group, weights=aligned)
    return ((flags & LOCAL) > 0) | (indexed[group] > aligned) | (aligned & (count[group] > 1))


def order_of(ids: list) -> np.ndarray:
    """Ids as unsigned numbers in the same order; null comes after all."""
    known = np.array([i if i is not None else 0 for i in ids], dtype=np.int64)
    out = known.view(np.uint64) ^ np.uint64(1 << 63)
    out[[i is None for i in ids]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out


def candidates(runs: Runs, ids: list, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows with a hit, the group of each, distinct windows, and the least id of each."""
    starts, group, _, _ = probes(runs)
    met = np.zeros(len(runs.owner) + 1, dtype=np.int64)
    met[starts[hit[group] > 0] + 1] = 1
    met = np.cumsum(met)
    windows, hashes = runs.of(WINDOW)
    has = met[windows + WINDOW - ANCHOR + 1] > met[windows]
    windows, hashes = windows[has], hashes[has]
    distinct, group, _ = grouped(hashes)
    least = np.full(len(distinct), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    np.minimum.at(least, group, order_of(ids)[runs.owner[windows]])
    return windows, group, distinct, least


def _probe_keys(block: Block, answers: dict) -> tuple[np.ndarray, np.ndarray]:
    _, _, distinct, flags = probes(Runs(block))
    return distinct, flags


def _window_keys(block: Block, answers: dict) -> tuple[np.ndarray, np.ndarray]:
    _, _, distinct, least = candidates(Runs(block), block.ids, answers["answers_hit"])
    return distinct, least


def smaller_elsewhere(keys: np.ndarray, least: np.ndarray, owner: np.ndarray) -> np.ndarray:
    distinct, group, _ = grouped(keys)
    lowest = np.full(len(distinct), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    np.minimum.at(lowest, group, least)
    return lowest[group] < least


def cleaned(block: Block, hit: np.ndarray, smaller: np.ndarray) -> dict[str, list]:
    """The result columns for the documents of a block."""
    runs = Runs(block)
    windows, group, _, least = candidates(runs, block.ids, hit)
    ids = order_of(block.ids)
    repeated = windows[(smaller[group] > 0) | (ids[runs.owner[windows]] > least[group])]
    removed = arrays.merged_within(repeated, repeated + WINDOW, runs.words.first)
    out: dict[str, list] = {name: [] for name in ("doc_id", "n_words", "n_removed", "spans", "kept")}
    for k, doc in enumerate(block.ids):
        a, b = removed[k]
        words = block.texts.text(k).split()
        edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(words)]
        kept = [w for p, q in zip(edges[::2], edges[1::2]) for w in words[p:q]]
        out["doc_id"].append(doc)
        out["n_words"].append(len(words))
        out["n_removed"].append(int((b - a).sum()))
        out["spans"].append([{"start": p, "end": q} for p, q in zip(a.tolist(), b.tolist())])
        out["kept"].append(b" ".join(kept))
    return out


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, spans, kept.

    ``spans`` are the removed words, from 0, the end exclusive; ``kept`` the other words joined by
    blanks. A null or short text loses nothing. A null id comes after all others, and rows with
    the same id lose nothing to each other. An empty table gives an empty result.
    """
    cut = blocks.stored_blocks(docs, id, text)
    buckets = blocks.bucket_count(cut)
    hit = stored(blocks.exchange(cut, _probe_keys, hits, buckets, key_kind="<u4", value_kind="u1"))
    smaller = blocks.exchange(blocks.with_answers(cut, hit=hit), _window_keys, smaller_elsewhere, buckets)
    told = blocks.with_answers(cut, hit=hit, smaller=smaller)
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
    ])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in blocks.opened(batch):
                answers = blocks.answers_in(batch, row)
                made = cleaned(block, answers["answers_hit"], answers["answers_smaller"])
                yield pa.RecordBatch.from_pydict(made, schema=kinds)

    return told.mapInArrow(finished, SCHEMA)
