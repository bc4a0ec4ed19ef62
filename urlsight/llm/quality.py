"""Quality rules on repetition inside a document, found with a suffix array over its words.

Suffixes of all documents of a run are sorted by prefix doubling. Neighbours in that order
share the longest common prefixes, and every interval of equal prefixes is a maximal repeated
substring; its occurrences are marked in the text. The rules limit the covered share of the
words and the longest repeat. Next to them stand plain counts: words, symbols, repeated lines.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.llm import arrays
from urlsight.llm.stored import by_place, extended, plain

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_covered_words", "longest_repeat",
)
SCHEMA = ", ".join(f"{name} long" for name in MEASURES) + ", base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rules:
    """``min_words`` and ``max_window_share`` make the base verdict, the rest the suffix array's.

    A repeat counts from ``repeat_words`` words on. A document goes if such repeats cover more
    than ``max_covered`` of its words, or if one repeat is longer than ``max_repeat`` of them. A
    sentence said twice is no fault of a short text: a repeat of up to ``sentence`` words is never
    too long, and repeats that cover no more than two such are never too many.
    """

    window: int = 3
    min_words: int = 50
    max_window_share: float = 0.5
    repeat_words: int = 8
    max_covered: float = 0.2
    max_repeat: float = 0.2
    sentence: int = 20


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules(), rejected: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``MEASURES``, ``base_failed`` and ``kept``, row by row.

    A map without a shuffle. A null text has no words and fails; an empty table stays empty;
    repeated rows are judged one by one. Columns of ``docs`` named like a new one are replaced.
    ``rejected=False`` leaves out the rows with ``kept`` false before they leave the task.
    """
    carried = [c for c in docs.columns if c not in {*MEASURES, "base_failed", "kept"}]
    source = by_place(docs, carried, __text=F.col(plain(text)).cast("binary"))
    out = extended(source, SCHEMA, without=("__text",))
    settings = asdict(rules)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(**settings)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for low, high, texts in arrays.runs(batch.column(at)):
                found = measures(texts, rules)
                rows = batch.slice(low, high - low)
                columns = [rows.column(i) for i in range(rows.num_columns) if i != at]
                names = [n for i, n in enumerate(rows.schema.names) if i != at]
                made = pa.RecordBatch.from_arrays(
                    [*columns, *[pa.array(v) for v in found.values()]], names=[*names, *found]
                )
                yield made if rejected else made.filter(pa.array(found["kept"]))

    return source.mapInArrow(judged, out).toDF(*carried, *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, those named like a measure included."""
    placed = by_place(docs, docs.columns)
    good = measure(placed, f"__{docs.columns.index(text)}", rules, rejected=False)
    return good.select(*placed.columns).toDF(*docs.columns)


def measures(texts: arrays.Texts, rules: Rules) -> dict[str, np.ndarray]:
    """The measures and verdicts of each text of a run."""
    words = texts.words()
    count = np.diff(words.first)
    data = texts.data[: texts.size]
    begins = (data & 0xC0) != 0x80
    symbols = np.zeros(256, dtype=bool)
    symbols[list(b"#*$%&|<>")] = True
    owner = np.repeat(np.arange(len(texts)), count)
    suffixes = Suffixes(words.hashes(texts), owner)
    repeated, covered = (
        np.bincount(owner[suffixes.covered(size)], minlength=len(texts))
        for size in (rules.window, rules.repeat_words)
    )
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, owner[suffixes.order[:-1]], suffixes.common)
    failed = (count < rules.min_words) | (repeated > rules.max_window_share * count)
    bad = (covered > np.maximum(rules.max_covered * count, 2 * rules.sentence)) | (
        longest > np.maximum(rules.max_repeat * count, rules.sentence)
    )
    return {
        "n_words": count.astype(np.int64),
        "word_chars": arrays.counted(begins & ~arrays.SPACES[data], texts.bounds),
        "n_symbols": arrays.counted(symbols[data], texts.bounds),
        "n_dup_lines": np.array([repeated_lines(texts.text(k)) for k in range(len(texts))], dtype=np.int64),
        "n_repeat_words": repeated,
        "n_covered_words": covered,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~failed & ~bad,
    }


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


class Suffixes:
    """Suffix array and longest common prefixes of word sequences, one for each owner.

    The owner is part of every word's key, so nothing matches across documents. A rank is the
    place where the suffixes with the same prefix begin in the sorted order. Each round sorts
    only the suffixes that still share a rank, by the rank of what follows their prefix, and
    so doubles the length of the prefix. The ranks of all rounds are kept, 4 bytes a word each, and there
    are as many rounds as the longest repeat has binary digits: a text of a million words that is
    one long repeat takes some 80 MB, others a few rounds' worth.
    """

    def __init__(self, hashes: np.ndarray, owner: np.ndarray):
        self.count = len(hashes)
        keys = arrays.joined(hashes, owner.astype(np.uint64))
        self.levels = [self._ranks(keys, np.arange(self.count), np.zeros(self.count, dtype=np.int64))]
        while (active := self._ties(self.levels[-1])).size:
            rank, width = self.levels[-1], 1 << (len(self.levels) - 1)
            follows = np.zeros(len(active), dtype=np.int64)
            inside = active + width < self.count
            follows[inside] = rank[active[inside] + width] + 1
            keys = (rank[active].astype(np.int64) << 32) | follows
            finer = rank.copy()
            finer[active] = self._ranks(keys, active, rank)[active]
            self.levels.append(finer)
        self.order = np.empty(self.count, dtype=np.int64)
        self.order[self.levels[-1]] = np.arange(self.count)
        self.common = self._common(self.order[:-1], self.order[1:])

    def _ranks(self, keys: np.ndarray, at: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Ranks for the positions ``at``, whose ``keys`` sort them inside their old ranks."""
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        here = np.arange(len(at))
        before = old[at]
        opens = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(at)]
        outer = np.concatenate([[True], before[1:] != before[:-1]])[: len(at)]
        first = np.maximum.accumulate(np.where(outer, here, 0))
        mine = np.maximum.accumulate(np.where(opens, here, 0))
        out = np.zeros(self.count, dtype=np.int32)
        out[at] = before + mine - first
        return out

    def _ties(self, rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=1)[rank] > 1) if self.count else rank

    def _common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, from the widest level down."""
        length = np.zeros(len(left), dtype=np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            near = np.flatnonzero(np.maximum(left, right) + length < self.count)
            same = self.levels[j][left[near] + length[near]] == self.levels[j][right[near] + length[near]]
            length[near[same]] += 1 << j
        return length

    def covered(self, size: int) -> np.ndarray:
        """Which words lie in a maximal repeat of at least ``size`` words."""
        long = np.flatnonzero(self.common >= size)
        inside = np.zeros(self.count + 1, dtype=np.int64)
        for at in (self.order[long], self.order[long + 1]):
            np.add.at(inside, at, 1)
            np.add.at(inside, at + self.common[long], -1)
        return np.cumsum(inside)[:-1] > 0
