"""Words, hashes and spans of many texts at once, as numpy arrays over UTF-8 bytes.

White space is always ``[\\x20\\x09-\\x0D]``. Texts arrive as binary Arrow columns, so offsets
are bytes and invalid UTF-8 does no harm. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that are worked on at once; one longer text makes a longer run.
RUN_BYTES = 1 << 21
PAD = 8

U64 = np.uint64
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_SPREAD = U64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts."""
    return mixed(left * _SPREAD + right + U64(1))


@dataclass
class Texts:
    """Some texts laid end to end, with zero bytes after the last."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def size(self) -> int:
        return int(self.bounds[-1])

    def text(self, k: int) -> bytes:
        return self.data[self.bounds[k]:self.bounds[k + 1]].tobytes()

    def words(self) -> Words:
        """Words as byte spans; ``first`` has the number of the first word of each text."""
        inside = ~SPACES[self.data[: self.size]]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < self.size)]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        start = np.flatnonzero(starts)
        return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, self.bounds))

    def eights(self) -> np.ndarray:
        """The eight bytes from each position on, as one little-endian number."""
        return np.ndarray((len(self.data) - PAD + 1,), dtype="<u8", buffer=self.data.data, strides=(1,))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, texts: Texts, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        view, size = texts.eights(), self.end - self.start
        out = mixed(size.astype(np.uint64) * _SPREAD + U64(seed))
        active, done = np.arange(len(size)), 0
        while active.size:
            left = np.minimum(size[active] - done, 8)
            out[active] = joined(out[active], view[self.start[active] + done] & _LOW_BYTES[left])
            done += 8
            active = active[size[active] > done]
        return out


def runs(column: pa.Array | pa.ChunkedArray, most: int = RUN_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cut a binary column into runs of whole texts: ``(from row, to row, texts)``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset: wide.offset + rows + 1]
    data = wide.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), rows)
        part = flat[offsets[low]: offsets[high]]
        yield low, high, Texts(np.concatenate([part, np.zeros(PAD, np.uint8)]), offsets[low: high + 1] - offsets[low])
        low = high


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours; fewer than ``size`` hashes give none.

    Runs are put together from runs of powers of two, so the work grows with log2(size).
    """
    if len(hashes) < size:
        return hashes[:0]
    whole, covered, block, width = None, 0, hashes, 1
    while True:
        if size & width:
            if whole is None:
                whole, covered = block, width
            else:
                count = min(len(whole), len(block) - covered)
                whole, covered = joined(whole[:count], block[covered: covered + count]), covered + width
        if covered == size:
            return whole[: len(hashes) - size + 1]
        block, width = joined(block[:-width], block[width:]), 2 * width


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans that neither overlap nor touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.concatenate([[True], start[1:] > reach[:-1]])
    closes = np.concatenate([opens[1:], [True]])
    return start[opens], reach[closes]


def merged_within(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The unions of spans inside each of the neighbouring stretches that ``bounds`` part.

    Spans of two stretches can touch; a gap of one between stretches keeps them apart.
    """
    gap = np.searchsorted(bounds, start, "right") - 1
    low, high = merged(start + gap, end + gap)
    cuts = np.searchsorted(low, bounds + np.arange(len(bounds)))
    return [
        (low[a:b] - bounds[k] - k, high[a:b] - bounds[k] - k)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
    ]


def counted(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
