"""The parts that run inside tasks, and paths that small tables do not reach on their own."""

import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urlsight.llm import (
    arrays, blocks, components, exact_dedup, fuse, licenses, packing, pii, quality, queries, sharding, simhash,
    suffix_dedup,
)


def one_run(texts):
    (_, _, run), = arrays.runs(pa.array([t.encode() for t in texts], pa.binary()), 1 << 30)
    return run


@given(st.lists(st.text(alphabet="ab \n\t\x0bé#", max_size=40), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_quality_measures(texts):
    found = quality.measures(one_run(texts), quality.Rules())
    for k, text in enumerate(texts):
        expected = brute.quality(text)
        assert tuple(int(found[n][k]) for n in quality.MEASURES) == expected[:7]


@given(st.text(alphabet="a1@.-_+ 0(5)9%,", max_size=80))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    base = [f for f in pii.findings(text) if f["kind"] in pii.BASE_KINDS]
    listed = ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in base)
    assert listed == brute.personal_data(text)[2]


@given(st.lists(st.sampled_from(["gnu", "general", "public", "license", "cc", "by", "mit", "apache", "é", "GPL", "- ", "\n"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_license_places(parts):
    text = " ".join(parts)
    words, places, _, _ = licenses.Scanner().scan(text.encode())
    starts = [p["word"] for p in places]
    labels = ",".join(sorted({p["label"] for p in places}))
    got = (words, len(places), min(starts, default=None), max(starts, default=None), labels)
    assert got == brute.license_base(text)


def test_every_license_rule_is_reached_by_its_keywords():
    """The keyword gate drops no hit: all rules without a gate give the same hits."""
    scanner, open_gate = licenses.Scanner(), licenses.Scanner()
    open_gate.rules = [
        licenses.Rule(r.label, r.kind, (b"",), r.pattern, r.priority, r.score) for r in open_gate.rules
    ]
    open_gate.words = [b""]
    assert len(scanner.rules) >= 300 and all(r.keywords for r in scanner.rules)
    draw = random.Random(1)
    for _, _, name, _ in licenses.FAMILIES:
        for _ in range(20):
            spelled = one_of(name, draw)
            version = draw.choice(["", " 2 0", " v3", " version 1 1", " license 3"])
            text = draw.choice(["licensed under the ", "x ", "spdx license identifier "]) + spelled + version
            assert scanner.scan(text.encode()) == open_gate.scan(text.encode())


def one_of(pattern, draw):
    """A string that the simple patterns of the families match."""
    while match := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
        choice = draw.choice(match.group(1).split("|")) if not match.group(2) or draw.random() < 0.7 else ""
        pattern = pattern[: match.start()] + choice + pattern[match.end():]
    pattern = re.sub(r"\[(.)[^\]]*\]", r"\1", pattern)
    return re.sub(r"(.)\?", lambda m: draw.choice(["", m.group(1)]), pattern)


def test_a_rule_hides_those_inside_it():
    hits = licenses.Scanner().scan(b"SPDX-License-Identifier: Apache-2.0")[2]
    assert [(h["label"], h["rule"]) for h in hits] == [("apache-2.0", "tag")]
    hits = licenses.Scanner().scan(b"released under the GNU General Public License version 3")[2]
    assert [h["label"] for h in hits] == ["gpl-3.0"]


def test_context_moves_scores():
    def score(text):
        return pii.findings(text)[0]["score"]

    assert score("call +44 20 7946 0958") > score("so +44 20 7946 0958") > score("invoice +44 20 7946 0958")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


@pytest.mark.parametrize("count", [0, 1, 2, 10, 1000, 50_000])
def test_fuse_filters(count):
    draw = np.random.default_rng(count)
    keys = draw.integers(0, 2**63, count).astype(np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    others = draw.integers(2**63, 2**64, 50_000, dtype=np.uint64)
    assert fuse.contains(blob, others).mean() < 0.01
    assert len(blob) < 1.5 * count + 1000


def test_colliding_digests_are_told_apart_by_their_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weak = F.substring(F.sha2(exact_dedup.normalised(F.col("text")), 256), 1, 1)
    order = ["doc_id", "keep_id", "group_size", "kept"]
    expected = exact_dedup.duplicates(docs).select(order).collect()
    got = exact_dedup.duplicates(docs, digest=weak, batches=3).select(order).collect()
    assert sorted(got) == sorted(expected)


def test_trie_blocks_of_any_size_give_the_same_classes(spark):
    draw = random.Random(3)
    prints = [draw.getrandbits(64) for _ in range(150)] + [0]
    for k in range(150):
        prints.append(prints[k] ^ (1 << draw.randrange(64)))
    crowd = draw.getrandbits(64)
    prints += [crowd ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(set(prints))]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    expected = linked(signed)
    for block in (12, 10_000):
        roots = components.components(simhash.links(nodes, 2, block))
        classes = {}
        for r in roots.collect():
            classes.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, classes.values())) == expected


def linked(prints):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[root(a)] = root(b)
    classes = {}
    for p in prints:
        classes.setdefault(root(p), []).append(p)
    return sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(edges).collect()
    assert sorted(r["node"] for r in found) == list(range(41)) and {r["root"] for r in found} == {0}


@given(st.lists(st.integers(0, 64), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit(sizes):
    bins, offsets, count = packing.best_fit(np.array(sizes, dtype=np.int64), 64)
    spans = {}
    for size, k, at in zip(sizes, bins.tolist(), offsets.tolist()):
        spans.setdefault(k, []).append((at, size))
    assert len(spans) == count
    for parts in spans.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(queries.tokenizer_path())


@given(st.text(alphabet="ab 's\n\t.1 é<|中²\x1c\x85", max_size=60))
@settings(max_examples=500, deadline=None)
def test_ids_are_those_of_the_tokenizers_library(encoder, text):
    assert encoder.fast is not None
    assert encoder.ids(text).tolist() == [*encoder.slow.encode(text, add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 9_000, "\n" * 9_000 + "x", "ab " * 20_000 + "é" * 5_000])
def test_long_runs_have_ids_too(encoder, text):
    assert encoder.ids(text).tolist() == [*encoder.slow.encode(text, add_special_tokens=False).ids, packing.END]


def test_repeats_across_ranges(spark):
    """Ranges of a few segments: equal windows meet across their boundaries."""
    draw = random.Random(9)
    passage = bytes(draw.choices(b"abcdefgh ", k=260)).decode()
    rows = [
        (k, "".join(draw.choices("ijklmnop ", k=150)) + passage + "".join(draw.choices("qrstuvw ", k=150)), None)
        for k in range(60)
    ]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string").repartition(12)
    old = suffix_dedup.RANGE_SEGMENTS
    try:
        suffix_dedup.RANGE_SEGMENTS = 5
        got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    finally:
        suffix_dedup.RANGE_SEGMENTS = old
    assert sorted(map(tuple, got)) == sorted(brute.repeated_bytes(rows))


def test_packed_keys_come_back():
    values = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    assert (blocks.numbers(blocks.planes(values), "<u8") == values).all()
    keys = np.sort(values)
    assert (np.diff(blocks.bucket_of(keys, 37)) >= 0).all()
    assert len(set(zip(blocks.bucket_of(keys, 37).tolist(), blocks.shortened(keys, 37).tolist()))) == len(set(keys.tolist()))


def test_range_of(spark):
    bounds = ["0300", "0500", "0900"]
    df = spark.createDataFrame([("0000",), ("0300",), ("0400",), ("0900",), ("zzzz",)], "k string")
    got = [r[0] for r in df.select(sharding.range_of(F.col("k"), bounds)).collect()]
    assert got == [0, 1, 1, 3, 3]


@pytest.mark.parametrize("size", [1, 7, 50])
def test_a_text_in_slices_has_the_same_fingerprint(monkeypatch, size):
    draw = random.Random(size)
    texts = [" ".join(draw.choices(["a", "Bc", "déf", "ghi"], k=k)) for k in (0, 1, 2, 3, 4, 40)]
    texts += ["  lead\t\n and  trail \x0b ", "x" * 200, "x" * 100 + " y " + "z" * 100]
    whole = [simhash.simhash(t.encode()) for t in texts]
    monkeypatch.setattr(simhash, "SLICE", size)
    assert [simhash.simhash(t.encode()) for t in texts] == whole
    assert simhash.simhash(texts[5].encode(), words=1) != 0


def test_a_word_that_the_bound_cuts_is_no_context():
    from urlsight.llm import pii

    assert pii.words_near("x" * 10 + "card " + "1" * 4, 15, 19) == {"x" * 10 + "card"}
    long = "discard" + " " * (pii.NEAR - 4) + "4111"
    assert "card" not in pii.words_near(long, len(long) - 4, len(long))
    after = "4111" + " " * (pii.NEAR - 4) + "cardinal"
    assert pii.words_near(after, 0, 4) == set()
    assert pii.words_near("my card: 4111 ok", 9, 13) == {"my", "card", "ok"}
