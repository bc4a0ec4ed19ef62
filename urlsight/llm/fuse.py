"""Static binary fuse filters: sets of 64-bit keys in about nine bits a key.

A key has three slots in neighbouring segments, and the filter holds it if the bytes in
its slots give its check byte when combined. A set that is asked for a key it holds always
says yes; for others it says yes once in 256 times.
"""

from __future__ import annotations

import math
import struct
import sys

import numpy as np
from pyspark import cloudpickle

from urlsight.llm import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)

_HEAD = "<QQQ"
_U = np.uint64


def _shape(count: int) -> tuple[int, int]:
    """Length of a segment, a power of two, and number of segments a first slot can be in."""
    length = 1 << max(2, min(18, int(math.log(max(count, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(count, 2)))
    return length, max(1, math.ceil(count * factor / length) - 2)


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key (one row each) and its check byte."""
    mix = arrays.mixed(keys + _U(seed) * _U(0x9E3779B97F4A7C15))
    first = ((mix >> _U(32)) * _U(segments * length)) >> _U(32)
    low = _U(length - 1)
    second = (first + _U(length)) ^ ((mix >> _U(18)) & low)
    third = (first + _U(2 * length)) ^ (mix & low)
    return np.stack([first, second, third]).astype(np.int64), (arrays.mixed(mix) & _U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct keys. Keys are peeled off in rounds, slots with one key first."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    for seed in range(1, 200):
        slots, check = _slots(keys, seed, length, segments)
        order = _peel(slots, (segments + 2) * length)
        if order is not None:
            return struct.pack(_HEAD, seed, length, segments) + _filled(slots, check, order, (segments + 2) * length).tobytes()
        segments += seed % 8 == 0
    raise RuntimeError("no seed gives a filter; are the keys distinct?")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    count = np.bincount(slots.ravel(), minlength=size)
    numbers = np.arange(slots.shape[1])
    marks = np.zeros(size, dtype=np.int64)
    for row in slots:
        np.bitwise_xor.at(marks, row, numbers)
    rounds, left = [], slots.shape[1]
    single = np.flatnonzero(count == 1)
    while left:
        if not single.size:
            return None
        keys, at = np.unique(marks[single], return_index=True)
        rounds.append((keys, single[at]))
        left -= len(keys)
        touched = slots[:, keys]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(marks, row, keys)
        touched = np.unique(touched)
        single = touched[count[touched] == 1]
    return rounds


def _filled(slots: np.ndarray, check: np.ndarray, rounds: list, size: int) -> np.ndarray:
    table = np.zeros(size, dtype=np.uint8)
    for keys, own in reversed(rounds):
        table[own] = 0
        table[own] = check[keys] ^ table[slots[0, keys]] ^ table[slots[1, keys]] ^ table[slots[2, keys]]
    return table


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold; none that it does hold is missed."""
    seed, length, segments = struct.unpack_from(_HEAD, blob)
    table = np.frombuffer(blob, dtype=np.uint8, offset=struct.calcsize(_HEAD))
    slots, check = _slots(keys.astype(np.uint64), seed, length, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == check
