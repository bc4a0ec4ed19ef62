"""Spelling variants against plain code: words, edits, filters, rounds, forms and roots."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from urlsight.llm import spelling


def brute_words(rows) -> dict[str, int]:
    def letter(c):
        return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"

    counts = Counter()
    for id, text in rows:
        runs, run = [], ""
        for c in (text or "") + " ":
            if letter(c):
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), None if forms[w] is None else words[forms[w]]))
    return sorted(out)


def crafted() -> list[tuple]:
    draw = random.Random(8)
    stems = ["".join(draw.choices("abcéñ", k=draw.randint(4, 7))) for _ in range(60)]
    stems += [stem[:k] + draw.choice("abñ") + stem[k + draw.randint(0, 1):] for stem in stems for k in (1, 3)]
    texts = [None, "", " \n", "1234 !", "ÀÉÎ×÷ÿ ÀÉÎ×÷ÿ àéîöøÿ", "ABCDE abcde AbCdE İstanbul İstanbul ſpell ſpell"]
    texts += [" ".join(draw.choices(stems, weights=range(1, 181), k=200)) for _ in range(12)]
    texts += ["chain " * 3 + "chaim " * 6 + "chaiz " * 12 + "thaiz " * 24 + "thaizz " * 48 + "xhaizz " * 96]
    texts += ["a" * 90 + " " + "a" * 91 + " " + "a" * 45 + "b" + "a" * 44] * 3 + ["q" * 3000 + " " + "q" * 2999] * 4
    texts += ["ties " * 4 + "tiesa tiesb tiesc tiesd ties" * 30]
    # One document's words a third of the table.
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[8])] * 10 + [(None, texts[9])] * 4 + [(-3, texts[10])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y") for i, t in crafted()]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int, `a.b` string").repartition(7).persist()


@pytest.fixture(scope="module")
def expected():
    return brute(brute_words(crafted()))


def grouped(docs):
    return sorted(map(tuple, spelling.group(docs).collect()))


def test_like_plain_code(docs, expected):
    assert sum(row[1] is not None for row in expected) > 30
    assert any(row[2] != row[1] for row in expected if row[1])
    assert grouped(docs) == expected


def test_many_rounds_of_small_filters(docs, expected, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 4)
    monkeypatch.setattr(spelling, "MOST_BYTES", 4 * 64 * 3)
    monkeypatch.setattr(spelling, "LETTERS", 300)
    monkeypatch.setattr(spelling, "HELD", 100)
    monkeypatch.setattr(spelling, "CUT", 50)
    assert grouped(docs) == expected


def test_filters_that_let_almost_all_through_change_nothing(docs, expected, monkeypatch):
    monkeypatch.setattr(spelling, "BITS_A_KEY", 0.1)
    monkeypatch.setattr(spelling, "LEAST_BLOCKS", 1)
    assert grouped(docs) == expected


def test_no_words(docs):
    assert grouped(docs.filter("text is null")) == []
    assert grouped(docs.limit(0)) == []


def test_hashes_of_edits_are_those_of_the_edited_words():
    words = ["hello", "aabbcc", "ñandú", "zzzzzzz", "a" * 70]
    letters = spelling.Letters(words)
    alphabet = [ord(c) for c in "abcehñz"]
    for put, at, hashes, lengths in letters.edits(alphabet):
        for k, h, size in zip(at, hashes, lengths):
            word, place = words[letters.owner[k]], letters.place[k]
            edited = word[:place] + put + word[place + 1:]
            assert len(edited) == size
            assert spelling.Letters([edited]).hashes()[0] == h


def test_filters_hold_all_their_keys():
    draw = random.Random(1)
    words = list({"".join(draw.choices("abcdefgh", k=draw.randint(5, 90))) for _ in range(3000)})
    letters = spelling.Letters(words)
    plan = spelling.Plan.of(Counter(spelling.shard_of(len(w)) for w in words))
    hashes = letters.hashes()
    place = plan.places(hashes, letters.sizes)
    assert place.min() >= 0 and place.max() < plan.blocks
    flat = np.zeros(plan.blocks * spelling.BLOCK_WORDS, dtype=np.uint64)
    more = spelling.arrays.mixed(hashes)
    for k in range(spelling.BITS_SET):
        word, bit = spelling.bit_of(more, k)
        np.bitwise_or.at(flat, place * spelling.BLOCK_WORDS + word, bit)
    assert len(spelling.passed(flat, 0, plan.blocks, place, hashes)) == len(words)
    others = spelling.Letters(["".join(draw.choices("stuvwxyz", k=20)) for _ in range(5000)])
    hit = spelling.passed(flat, 0, plan.blocks, plan.places(others.hashes(), others.sizes), others.hashes())
    assert len(hit) < 100
