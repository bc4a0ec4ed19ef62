"""Secrets in texts: a linear-chain conditional random field beside three fixed patterns.

A text is a chain of tokens. The field tags each of them as the begin or inside of a secret or as
outside of any, from its shape, the words and marks beside it and features of the whole file;
Viterbi decoding finds the best tags of the chain. Weights are whole numbers, so decoding is exact
and the same everywhere, and tokens that are outside on every best path cut the chain into short
pieces that are decoded side by side.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.llm import arrays, secret_samples
from urlsight.llm.stored import by_place, extended, plain

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)

SCHEMA = "findings array<struct<kind: string, start: long, end: long>>"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "secret")

# All of it is ASCII, so bytes are searched; letters of the names are matched in either case.
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

# Tags.
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS = 3

#: Rows of the weight table that features are hashed into, and the unit of a weight.
TABLE_BITS = 15
UNIT = 256
#: Tokens whose features are made at once; the two before and the one after give context.
TOKENS = 1 << 17
BEFORE, AFTER = 2, 1

#: Texts of the corpus that training sees as surroundings, and code points of each.
SAMPLE_TEXTS = 150
SAMPLE_LENGTH = 1500
#: Generated texts, passes over all of them, and the penalty of large weights.
GENERATED = 2500
PASSES = 40
PENALTY = 0.02

_ASCII = np.arange(256)


def _bytes(text: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(text.encode(), dtype=np.uint8)] = True
    return table


LOWER, UPPER, DIGIT = (_bytes(t) for t in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
SYMBOL, HIGH = _bytes("+/_.-$!#%^*~\\"), _ASCII >= 128
#: Bit of a byte's class; 0 parts tokens.
CLASS = (LOWER + 2 * UPPER + 4 * DIGIT + 8 * SYMBOL + 16 * HIGH).astype(np.uint8)
HEXDIGIT = _bytes("0123456789abcdef")
#: Bit of a mark between tokens.
MARK = (
    1 * _bytes("\n\r") + 2 * _bytes(":=") + 4 * _bytes("\"'`") + 8 * _bytes("@") + 16 * _bytes("()[]{}<>") + 32 * _bytes(",;&?|")
).astype(np.uint8)
CODE = _bytes("=;{}[]\"_")
SIZES = np.digitize(np.arange(65), [2, 3, 4, 5, 7, 9, 13, 17, 25, 32, 49]).astype(np.uint64)

U64 = np.uint64
Span = tuple[int, int]


# ------------------------------------------------------------------ fixed patterns


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in bytes."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _values(text: bytes) -> list[Span]:
    """The secrets themselves in the matches of the fixed patterns, for training."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [m.span() for m in HEX.finditer(text)]


# ------------------------------------------------------------------ features


@dataclass
class Chain:
    """The tokens of some texts: byte spans, the text of each, and a feature of that text."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    file: np.ndarray

    @classmethod
    def of(cls, texts: arrays.Texts) -> Chain:
        data = texts.data[: texts.size]
        inside = CLASS[data] != 0
        # The full stop of a sentence and the slashes after a scheme belong to no token.
        stop = data == ord(".")
        stop[:-1] &= ~inside[1:]
        slash = data == ord("/")
        scheme = np.zeros_like(stop)
        scheme[1:] = slash[1:] & (data[:-1] == ord(":"))
        scheme[2:] |= slash[2:] & scheme[1:-1]
        inside &= ~stop & ~scheme
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = texts.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < texts.size)]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, texts.bounds)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
        return cls(start, end, owner, _files(texts))


def _files(texts: arrays.Texts) -> np.ndarray:
    """What kind of file a text is: how dense marks of code, digits and line ends are."""
    size = np.maximum(np.diff(texts.bounds), 1)
    out = np.zeros(len(texts), dtype=np.uint64)
    for table, steps in ((CODE, (0.002, 0.01, 0.04)), (DIGIT, (0.005, 0.03, 0.1)), (MARK & 1 > 0, (0.002, 0.01, 0.03))):
        count = np.concatenate([[0], np.cumsum(table[texts.data[: texts.size]], dtype=np.int64)])
        share = (count[texts.bounds[1:]] - count[texts.bounds[:-1]]) / size
        out = out * U64(4) + np.digitize(share, steps).astype(np.uint64)
    return out


def _either(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bits found between ``low`` and ``high``, for spans that follow one another."""
    edges = np.stack([low, high], axis=1).reshape(-1)
    return np.bitwise_or.reduceat(table, edges)[::2]


def features(data: np.ndarray, chain: Chain, low: int, high: int) -> Iterator[np.ndarray]:
    """Rows of the weight table, one array for each feature of the tokens from ``low`` to ``high``."""
    first, last = max(low - BEFORE, 0), min(high + AFTER, len(chain.start))
    base = int(chain.start[first])
    start, end = chain.start[first:last] - base, chain.end[first:last] - base
    owner = chain.owner[first:last]
    part = data[base: base + int(end[-1]) + arrays.PAD]
    part = np.concatenate([part, np.zeros(max(0, int(end[-1]) + arrays.PAD - len(part)), np.uint8)])
    size = end - start
    kinds = CLASS[part]
    shape = _either(kinds, start, end).astype(np.uint64)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[end] - total[start]

    changes = np.zeros(len(part), dtype=bool)
    changes[1:] = kinds[1:] != kinds[:-1]
    changes[start] = False
    mixed = (10 * count(changes) // size).astype(np.uint64)
    digits = (4 * count(DIGIT[part]) // size).astype(np.uint64)
    hexed = (count(HEXDIGIT[part]) == size).astype(np.uint64)
    length = SIZES[np.minimum(size, 64)]

    lowered = part.copy()
    lowered[UPPER[part]] += 32
    whole = arrays.Texts(lowered, np.array([0, len(lowered) - arrays.PAD]))
    words = arrays.Words(start, np.minimum(end, start + 24), start[:0]).hashes(whole) + size.astype(np.uint64)
    heads = arrays.Words(start, np.minimum(end, start + 4), start[:0]).hashes(arrays.Texts(part, whole.bounds), 1)

    none = U64(77)

    def at(values: np.ndarray, step: int) -> np.ndarray:
        """The values of the token ``step`` further on in the same text."""
        out = np.full(len(values), none)
        if step < 0:
            same = owner[-step:] == owner[:step]
            out[-step:][same] = values[:step][same]
        else:
            same = owner[:-step] == owner[step:]
            out[:-step][same] = values[step:][same]
        return out

    after = np.full(len(start), 64, dtype=np.uint64)
    if len(start) > 1:
        after[:-1] = _either(MARK[part], end[:-1], start[1:])
    after[:-1][owner[1:] != owner[:-1]] = 64
    before = at(after, -1)
    file = chain.file[owner]

    shaped = shape * U64(16) + length
    values = [
        np.zeros(len(start), np.uint64), shaped, shaped * U64(16) + mixed, shape * U64(8) + digits,
        length * U64(2) + hexed, words, heads, at(words, -1), at(words, -2), at(words, 1),
        before * U64(128) + after, before * U64(32) + shape, arrays.joined(at(words, -1), before),
        arrays.joined(arrays.joined(at(words, -1), before), shaped), at(shaped, -1), at(shaped, 1),
        file, file * U64(32) + shape, arrays.joined(at(heads, -1), shaped),
    ]
    keep = slice(low - first, high - first)
    for number, value in enumerate(values):
        yield (arrays.joined(value[keep], np.full(high - low, number, np.uint64)) >> U64(64 - TABLE_BITS)).astype(np.int64)


# ------------------------------------------------------------------ the field


@dataclass(frozen=True)
class Field:
    """Weights in units: of feature rows by tag, and of a tag after another (before the first is outside)."""

    weights: np.ndarray
    follow: np.ndarray

    def emissions(self, data: np.ndarray, chain: Chain) -> np.ndarray:
        out = np.zeros((len(chain.start), TAGS), dtype=np.int32)
        for low in range(0, len(out), TOKENS):
            high = min(low + TOKENS, len(out))
            for rows in features(data, chain, low, high):
                out[low:high] += self.weights[rows]
        return out

    def margins(self) -> np.ndarray:
        """By how much outside must lead a tag at a token, to be on every best path there.

        What another tag at the token can gain at most from the tags before and after it.
        """
        gain = (self.follow - self.follow[:, [OUTSIDE]]).max(axis=0)
        later = (self.follow - self.follow[[OUTSIDE]]).max(axis=1)
        return gain + np.maximum(later, 0)

    def decode(self, scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The best tags of all chains (Viterbi); of equal paths the one with the lower tags at the end."""
        lead = scores[:, [OUTSIDE]] - scores
        bound = self.margins()
        open_ = np.flatnonzero((lead[:, BEGIN] <= bound[BEGIN]) | (lead[:, INSIDE] <= bound[INSIDE]))
        tags = np.zeros(len(scores), dtype=np.int8)
        if not len(open_):
            return tags
        apart = (np.diff(open_) > 1) | (owner[open_[1:]] != owner[open_[:-1]])
        heads = np.concatenate([[0], np.flatnonzero(apart) + 1])
        first, size = open_[heads], np.diff(np.append(heads, len(open_)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        back = np.zeros((len(scores), TAGS), dtype=np.int8)
        best = self.follow[OUTSIDE] + scores[first]
        for step in range(1, int(size[0])):
            n = live[step]
            ways = best[:n, :, None] + self.follow
            at = first[:n] + step
            back[at] = ways.argmax(axis=1)
            best[:n] = ways.max(axis=1) + scores[at]
        last = first + size - 1
        # A piece that another token of its text follows goes on to outside.
        more = np.minimum(last + 1, len(owner) - 1)
        goes_on = (last + 1 < len(owner)) & (owner[more] == owner[last])
        tag = (best + np.where(goes_on[:, None], self.follow[:, OUTSIDE], 0)).argmax(axis=1)
        for step in range(int(size[0]) - 1, -1, -1):
            n = live[step]
            at = first[:n] + step
            ends = size[:n] == step + 1
            current = np.where(ends, tag[:n], 0)
            if step + 1 < int(size[0]):
                m = live[step + 1]
                current[:m] = back[at[:m] + 1, tags[at[:m] + 1]]
            tags[at] = current
        return tags

    def spans(self, texts: arrays.Texts) -> Iterator[tuple[int, int, int]]:
        """``(text, start, end)`` of the tagged secrets, in bytes of all texts laid end to end."""
        chain = Chain.of(texts)
        tags = self.decode(self.emissions(texts.data, chain), chain.owner)
        tagged = np.flatnonzero(tags)
        current = None
        for k in tagged:
            goes_on = current and tags[k] == INSIDE and k == current[3] + 1 and chain.owner[k] == current[0]
            if current and not goes_on:
                yield current[0], current[1], current[2]
            begin = current[1] if goes_on else int(chain.start[k])
            current = (int(chain.owner[k]), begin, int(chain.end[k]), k)
        if current:
            yield current[0], current[1], current[2]


# ------------------------------------------------------------------ training


def labelled(samples: list[tuple[bytes, list[Span]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(feature rows, tags, text)`` of every token; tokens of a listed span are its begin and inside."""
    texts = next(arrays.runs(pa.array([t for t, _ in samples], pa.binary()), 1 << 60))[2]
    chain = Chain.of(texts)
    tags = np.zeros(len(chain.start), dtype=np.int64)
    for k, (_, spans) in enumerate(samples):
        for low, high in spans:
            low, high = low + texts.bounds[k], high + texts.bounds[k]
            inside = np.arange(np.searchsorted(chain.end, low, "right"), np.searchsorted(chain.start, high))
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
    rows = np.stack(list(features(texts.data, chain, 0, len(tags))), axis=1)
    return rows, tags, chain.owner


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def expected(scores: np.ndarray, follow: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chances of each token's tags, expected counts of neighbouring tags, and the log of all paths' sum.

    Forward and backward sums of all chains side by side, the longest first.
    """
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(np.append(first, len(owner)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[first] = follow[OUTSIDE] + scores[first]
    for step in range(1, longest):
        at = first[: live[step]] + step
        forward[at] = _log_sum(forward[at - 1][:, :, None] + follow, 1) + scores[at]
    for step in range(longest - 2, -1, -1):
        at = first[: live[step + 1]] + step
        backward[at] = _log_sum(follow + (scores[at + 1] + backward[at + 1])[:, None, :], 2)
    total = _log_sum(forward[first + size - 1], 1)
    whole = np.zeros(len(owner))
    whole[np.concatenate([np.arange(f, f + s) for f, s in zip(first, size)])] = np.repeat(total, size)
    chances = np.exp(forward + backward - whole[:, None])
    later = np.ones(len(owner), dtype=bool)
    later[first] = False
    at = np.flatnonzero(later)
    pairs = forward[at - 1][:, :, None] + follow + (scores[at] + backward[at])[:, None, :] - whole[at][:, None, None]
    moves = np.exp(pairs).sum(axis=0)
    moves[OUTSIDE] += chances[first].sum(axis=0)
    return chances, moves, float(total.sum())


def fit(rows: np.ndarray, tags: np.ndarray, owner: np.ndarray, passes: int = PASSES, penalty: float = PENALTY) -> Field:
    """Weights that make the given tags likely: gradient steps with a step size for each weight."""
    table, follow = np.zeros((1 << TABLE_BITS, TAGS)), np.zeros((TAGS, TAGS))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    before = np.concatenate([[OUTSIDE], tags[:-1]])
    before[first] = OUTSIDE
    seen_moves = np.zeros((TAGS, TAGS))
    np.add.at(seen_moves, (before, tags), 1)
    flat = rows.reshape(-1)
    moments = [[np.zeros_like(table), np.zeros_like(table)], [np.zeros_like(follow), np.zeros_like(follow)]]
    for turn in range(1, passes + 1):
        scores = table[rows].sum(axis=1)
        chances, moves, _ = expected(scores, follow, owner)
        miss = -chances
        miss[np.arange(len(tags)), tags] += 1
        slope = np.stack([
            np.bincount(flat, np.repeat(miss[:, t], rows.shape[1]), 1 << TABLE_BITS) for t in range(TAGS)
        ], axis=1) - penalty * table
        for weights, gradient, (mean, square) in (
            (table, slope, moments[0]), (follow, seen_moves - moves - penalty * follow, moments[1])
        ):
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            step = mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
            weights += 0.2 * (1 - turn / (passes + 1)) * step
    return Field(np.rint(table * UNIT).astype(np.int32), np.rint(follow * UNIT).astype(np.int32))


@lru_cache(maxsize=4)
def trained(surroundings: tuple[bytes, ...] = (), count: int = GENERATED, seed: int = 1) -> Field:
    """A field fitted to generated texts and to texts of the corpus, labelled by the fixed patterns."""
    samples = [(t, _values(t)) for t in surroundings]
    samples += secret_samples.generated(count, seed, surroundings)
    return fit(*labelled(samples))


def surroundings(docs: DataFrame, text: str = "text") -> tuple[bytes, ...]:
    """At most ``SAMPLE_TEXTS`` pieces of texts of ``SAMPLE_LENGTH`` code points, picked by a hash."""
    body = F.col(plain(text))
    texts = docs.filter(F.length(body) > 0).select(F.xxhash64(body).alias("draw"), body.alias("body"))
    # First the draws alone, so that no more than a number of each task's best reaches the driver.
    draws = [r["draw"] for r in texts.select("draw").distinct().orderBy("draw").limit(SAMPLE_TEXTS).collect()]
    place = F.pmod("draw", F.greatest(F.length("body") - SAMPLE_LENGTH, F.lit(1))).cast("int") + 1
    piece = F.substr(F.col("body"), place, F.lit(SAMPLE_LENGTH))
    picked = texts.filter(F.col("draw").isin(draws)).select("draw", piece.alias("piece")).distinct().orderBy("draw", "piece").collect()
    return tuple(r["piece"].encode("utf-8", "replace") for r in picked)


# ------------------------------------------------------------------ scan


def apart(spans: list[tuple], others: list[tuple]) -> list[tuple]:
    """The spans ``(start, kind, end)`` that overlap none of the others."""
    if not spans or not others:
        return spans
    low, high = arrays.merged(np.array([o[0] for o in others]), np.array([o[2] for o in others]))
    before = np.searchsorted(low, [s[2] for s in spans])
    return [s for s, b in zip(spans, before) if not b or high[b - 1] <= s[0]]


def findings(texts: arrays.Texts, field: Field) -> list[list[dict]]:
    """Findings of each text by start, then kind; offsets are code points, the end exclusive."""
    extra = [[] for _ in range(len(texts))]
    for k, start, end in field.spans(texts):
        extra[k].append((int(start - texts.bounds[k]), KINDS.index("secret"), int(end - texts.bounds[k])))
    out = []
    for k in range(len(texts)):
        text = texts.text(k)
        base = base_spans(text)
        # A tagged secret that a pattern has found too is not reported twice.
        found = sorted(base + apart(extra[k], base))
        if found and not text.isascii():
            # Code points before a byte: bytes that do not continue a character.
            begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            found = [(int(begins[s]), kind, int(begins[e])) for s, kind, e in found]
        out.append([{"kind": KINDS[kind], "start": s, "end": e} for s, kind, e in found])
    return out


def scan(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, plus ``findings``; a map without a shuffle.

    Without ``field`` one is fitted first, to generated texts and a bounded sample of these
    (``SAMPLE_TEXTS``). A null or empty text has no findings; repeated rows are scanned one by one, an
    empty table stays empty; of spans that start together the kinds come as listed in ``KINDS``. A very long text
    is one chain, its features are made ``TOKENS`` tokens at a time: memory is about 20 bytes a byte of it.
    """
    field = field or trained(surroundings(docs, text))
    carried = [c for c in docs.columns if c not in (text, "findings")]
    source = by_place(docs, carried, __text=F.col(plain(text)).cast("binary"))
    out = extended(source, SCHEMA, without=("__text",))
    names = out.names
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    # Arrays, because a broadcast holds classes by reference.
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.follow))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for low, high, texts in arrays.runs(batch.column(at)):
                part = batch.slice(low, high - low)
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(findings(texts, field), kind)], names=names)

    return source.mapInArrow(scanned, out).toDF(*carried, "findings")


def listed(findings: Column) -> Column:
    """``kind:start:end`` of each finding, joined by commas."""
    return F.concat_ws(",", F.transform(
        findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    ))
