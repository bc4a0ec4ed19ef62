"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Every word generates its edits, but only half of them: deletions reach the shorter neighbours,
replacements by a later letter the equally long ones; the others find this word in turn. Edits
are hashed without being spelled out and probed against blocked Bloom filters of the
vocabulary, one filter for each length, broadcast in rounds of bounded size. What the filters
let through is spelled out and shuffled to an exact join with the vocabulary.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.llm import arrays
from urlsight.llm.stored import plain, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Characters of counted words that a task holds before it hands them on, and of a text cut at once.
HELD = 16 << 20
CUT = 1 << 20

#: A Bloom block is a row of 512 bits; a key sets so many of them, and has so many to itself.
BLOCK_WORDS = 8
BITS_SET = 6
BITS_A_KEY = 16
#: Longer words have more edits; from this length on their filters grow with the cube root.
LONG = 16
LEAST_BLOCKS = 16
#: Up to this length each length has a filter; longer words share one for each power of two.
LENGTHS = 64
#: Blocks in a piece of a filter that one task builds, and bytes of filters in one broadcast.
PIECE = 1024
MOST_BYTES = 64 << 20
#: Letters of words whose edits are hashed at once.
LETTERS = 1 << 17

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
U64 = np.uint64


# ------------------------------------------------------------------ words


def slices(text: str, most: int = CUT) -> Iterator[str]:
    """A long text in slices that cut no run of letters."""
    low = 0
    while len(text) - low > most:
        end = NO_LETTER.search(text, low + most)
        high = end.end() if end else len(text)
        yield text[low:high]
        low = high
    yield text[low:]


def spellings(doc_id: int | None, text: bytes | None) -> Iterator[tuple[str, int]]:
    """Lower-cased runs of letters and how often they occur, some with a letter left out.

    Which ones is decided by a checksum of document and run, so that reruns agree.
    """
    runs = Counter()
    # On bytes ``lower`` changes A to Z only.
    for part in slices((text or b"").lower().decode("utf-8", "replace")):
        runs.update(RUN.findall(part))
    head = "" if doc_id is None else str(doc_id)
    for run, count in runs.items():
        check = zlib.crc32(f"{head}:{run}".encode())
        if check % 97 == 0:
            place = check % len(run)
            run = run[:place] + run[place + 1:]
        if len(run) >= LEAST_LENGTH:
            yield run, count


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``; counts are combined in each task first."""
    source = docs.select(F.col(plain(id)).cast("long").alias("id"), F.col(plain(text)).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            words, times = list(counts.keys()), list(counts.values())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["word", "n"])

        counts, size = Counter(), 0
        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1)):
                for word, count in spellings(doc_id.as_py(), body.as_py()):
                    if word not in counts:
                        size += len(word)
                    counts[word] += count
                if size > HELD:
                    yield out(counts)
                    counts, size = Counter(), 0
        yield out(counts)

    counts = source.mapInArrow(counted, "word string, n long")
    return written(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "vocabulary")


# ------------------------------------------------------------------ filters


def shard_of(length: int) -> int:
    return length if length <= LENGTHS else LENGTHS + length.bit_length()


@dataclass(frozen=True)
class Plan:
    """Where the filter of each length lies in the row of all blocks: ``shard: (start, blocks)``."""

    shards: dict[int, tuple[int, int]]
    blocks: int

    @classmethod
    def of(cls, counts: dict[int, int]) -> Plan:
        """``counts`` has the number of words of each shard."""
        shards, start = {}, 0
        for shard, count in sorted(counts.items()):
            length = shard if shard <= LENGTHS else 1 << (shard - LENGTHS)
            bits = BITS_A_KEY * max(1.0, length / LONG) ** (1 / 3)
            blocks = max(LEAST_BLOCKS, int(count * bits / (64 * BLOCK_WORDS)) + 1)
            shards[shard] = (start, blocks)
            start += blocks
        return cls(shards, start)

    def places(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The block of each key; -1 where no word has its length."""
        start = np.full(shard_of(int(lengths.max(initial=0))) + 1, -1, dtype=np.int64)
        blocks = np.ones(len(start), dtype=np.uint64)
        for shard, (first, count) in self.shards.items():
            if shard < len(start):
                start[shard], blocks[shard] = first, count
        shard = np.where(lengths <= LENGTHS, lengths, LENGTHS + np.frexp(lengths.astype(np.float64))[1])
        inside = ((hashes >> U64(32)) * blocks[shard]) >> U64(32)
        return np.where(start[shard] >= 0, start[shard] + inside.astype(np.int64), -1)


def bit_of(more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k``-th bit that keys set in their blocks: number of the word, and the word with it."""
    bit = (more >> U64(9 * k)) & U64(64 * BLOCK_WORDS - 1)
    return (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63))


class Letters:
    """Words as their code points laid end to end; all are below 256, a byte each."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.first[self.owner]
        steps = np.full(int(self.sizes.max(initial=0)), _BASE, dtype=np.uint64)
        steps[:1] = 1
        self.power = np.cumprod(steps)[self.place]
        # Sums of all letters before; modulo 2^64 differences of them are exact.
        self.before = np.concatenate([[U64(0)], np.cumsum((self.codes.astype(np.uint64) + U64(1)) * self.power)])
        self.sums = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def hashes(self) -> np.ndarray:
        return finished(self.sums, self.sizes)

    def edits(self, alphabet: list[int]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """``(what a letter becomes, letters, hashes, lengths)`` of all edits, letter by letter of the alphabet.

        Of a run of equal letters the first is left out; only a later letter replaces one.
        """
        repeat = np.zeros(len(self.codes), dtype=bool)
        repeat[1:] = (self.codes[1:] == self.codes[:-1]) & (self.place[1:] > 0)
        at = np.flatnonzero(~repeat & (self.sizes[self.owner] > LEAST_LENGTH))
        own = self.owner[at]
        head = self.before[at] - self.before[self.first[own]]
        tail = (self.before[self.first[own + 1]] - self.before[at + 1]) * _BACK
        yield "", at, finished(head + tail, self.sizes[own] - 1), self.sizes[own] - 1
        for letter in alphabet:
            at = np.flatnonzero(self.codes < letter)
            own = self.owner[at]
            more = (letter - self.codes[at].astype(np.int64)).astype(np.uint64) * self.power[at]
            yield chr(letter), at, finished(self.sums[own] + more, self.sizes[own]), self.sizes[own]


def finished(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return arrays.mixed(sums + lengths.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def _batches(batch: pa.RecordBatch, most: int = LETTERS) -> Iterator[tuple[int, int]]:
    """Rows of a batch in runs of about ``most`` letters."""
    sizes = np.cumsum(np.asarray(pc.utf8_length(batch.column(0)), dtype=np.int64))
    low = 0
    while low < len(sizes):
        before = sizes[low - 1] if low else 0
        high = max(int(np.searchsorted(sizes, before + most, "right")), low + 1)
        yield low, high
        low = high


def pieces(words: DataFrame, plan: Plan) -> DataFrame:
    """``(piece, bits)``: the filters in pieces of ``PIECE`` blocks, each built by one task."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _batches(batch):
                letters = Letters(batch.column(0).slice(low, high - low).to_pylist())
                hashes = letters.hashes()
                place = plan.places(hashes, letters.sizes)
                order = np.argsort(place)
                hashes, place = hashes[order], place[order]
                cuts = np.flatnonzero(np.diff(place // PIECE, prepend=-1, append=-1))
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(place[a]) // PIECE for a, _ in spans], pa.int64()),
                    pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([hashes[a:b].tobytes() for a, b in spans], pa.binary()),
                ], names=["piece", "places", "hashes"])

    def built(table: pa.Table) -> pa.Table:
        flat = np.zeros(PIECE * BLOCK_WORDS, dtype=np.uint64)
        for places, hashes in zip(table["places"], table["hashes"]):
            block = np.frombuffer(places.as_py(), dtype=np.int64) % PIECE
            more = arrays.mixed(np.frombuffer(hashes.as_py(), dtype=np.uint64))
            for k in range(BITS_SET):
                word, bit = bit_of(more, k)
                np.bitwise_or.at(flat, block * BLOCK_WORDS + word, bit)
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([flat.tobytes()], pa.binary())})

    keys = words.select("word").mapInArrow(keyed, "piece long, places binary, hashes binary")
    return written(keys.groupBy("piece").applyInArrow(built, "piece long, bits binary"), "bloom-pieces")


def passed(flat: np.ndarray, low: int, high: int, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which keys the filters of the blocks from ``low`` to ``high`` say they hold."""
    alive = np.flatnonzero((place >= low) & (place < high))
    row, more = (place[alive] - low) * BLOCK_WORDS, arrays.mixed(hashes[alive])
    for k in range(BITS_SET):
        word, bit = bit_of(more, k)
        yes = (flat[row + word] & bit) != 0
        alive, row, more = alive[yes], row[yes], more[yes]
    return alive


# ------------------------------------------------------------------ neighbours


def _guided(words: DataFrame, plan: Plan, filters: DataFrame, alphabet: list[int]) -> list[DataFrame]:
    """``(word, n, near)`` of edits that the filters let through, a table for each round."""
    context = words.sparkSession.sparkContext
    step = max(1, MOST_BYTES // (PIECE * BLOCK_WORDS * 8))
    total = -(-plan.blocks // PIECE)
    out = []
    for first in range(0, total, step):
        last = min(first + step, total)
        flat = np.zeros((last - first) * PIECE * BLOCK_WORDS, dtype=np.uint64)
        for row in filters.filter(F.col("piece").between(first, last - 1)).toLocalIterator():
            at = (row["piece"] - first) * PIECE * BLOCK_WORDS
            flat[at: at + PIECE * BLOCK_WORDS] = np.frombuffer(row["bits"], dtype=np.uint64)
        sent = context.broadcast(flat)
        low, high = first * PIECE, last * PIECE

        def probed(batches: Iterator[pa.RecordBatch], sent=sent, low=low, high=high) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end in _batches(batch):
                    words_ = batch.column(0).slice(begin, end - begin).to_pylist()
                    letters = Letters(words_)
                    owner, near = [], []
                    for put, at, hashes, lengths in letters.edits(alphabet):
                        for k in at[passed(sent.value, low, high, plan.places(hashes, lengths), hashes)]:
                            own, place = int(letters.owner[k]), int(letters.place[k])
                            owner.append(begin + own)
                            near.append(words_[own][:place] + put + words_[own][place + 1:])
                    places = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(places), batch.column(1).take(places), pa.array(near, pa.string())],
                        names=["word", "n", "near"],
                    )

        out.append(written(words.select("word", "n").mapInArrow(probed, "word string, n long, near string"), "guided"))
        sent.unpersist()
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)`` for all pairs of words one edit apart, in both directions.

    ``words`` is a stored table ``(word, n)`` of distinct words of code points below 256.
    """
    size = "length(word)"
    shard = F.expr(f"if({size} <= {LENGTHS}, {size}, {LENGTHS} + length(bin({size})))")
    counts = {r["shard"]: r["count"] for r in words.groupBy(shard.alias("shard")).count().collect()}
    plan = Plan.of(counts)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, dtype=bool)
        for batch in batches:
            seen[np.frombuffer("".join(batch.column(0).to_pylist()).encode("latin-1"), dtype=np.uint8)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["letter"])

    # 256 letters at most.
    alphabet = sorted(r["letter"] for r in words.select("word").mapInArrow(used, "letter int").distinct().collect())
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = None
    for guided in _guided(words, plan, pieces(words, plan), alphabet):
        found = guided if found is None else found.unionByName(guided)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    pairs = written(found.join(exact, "near").select("word", "n", "near", "near_n"), "near-words")
    return pairs.unionByName(pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    ))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of a stored table ``(word, form)`` without circles: the last form of each.

    Every round doubles the steps that are done. A form is at least twice as frequent as its
    word, so paths are short and the rounds few.
    """
    current = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(current.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ), "roots")
        current = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return current


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a stored vocabulary ``(word, n)``.

    A word's form is its most frequent neighbour (ties: the least in code-point order), if that is at least
    ``factor`` times as frequent; its root is where forms lead, the word itself without one.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    grouped = written(
        neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.max("n").alias("n"))
        .select("word", "n_near", F.expr(f"if(-best.minus >= {factor} * n, best.near, null)").alias("form"),
                F.expr(f"if(-best.minus >= {factor} * n, -best.minus, null)").alias("form_n")),
        "forms",
    )
    last = roots(grouped.filter("form is not null"))
    return (
        words.join(grouped, "word", "left").join(last, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )


def group(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts, one row each, with the spelling they are a variant of.

    Words are runs of Latin letters, A to Z lower-cased, of ``LEAST_LENGTH`` code points and
    ``LEAST_COUNT`` occurrences or more; see ``spellings`` for those that lose a letter. A null or
    empty text has no words, a null id counts as an empty one, repeated rows count each time.
    An empty table has no words. Long texts are cut between words; a run of letters of any
    length is one word. Columns other than id and text are not read.
    """
    return variants(vocabulary(docs, id, text))
