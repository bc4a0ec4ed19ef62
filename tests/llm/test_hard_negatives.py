"""Hard negatives against plain code: odd rows, ties, copies, and the form for many anchors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from urlsight.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, `a.b c` int, bucket int, key int"


def crafted() -> list[tuple]:
    draw = random.Random(3)
    centers = [[draw.gauss(0, 0.2) for _ in range(8)] for _ in range(4)]
    rows = []
    for k in range(400):
        label = draw.randrange(4)
        rows.append((k, [x + draw.gauss(0, 0.1) for x in centers[label]], label))
    copy = [0.3] * 8
    rows += [(1000 + k, copy, k % 3) for k in range(200)]  # one vector a third of the table
    rows += [(5, None, 1), (6, [0.1] * 8, None), (7, [0.1, None], 1), (8, [math.nan] * 8, 1), (9, [math.inf] * 8, 1)]
    rows += [(None, copy, 0), (None, copy, 1), (2000, [], 1), (2100, [0.5] * 20, 1), (2200, [0.0] * 8, 2), (2201, [0.0], 2)]
    rows += [(-100, [-0.2] * 8, 0), (-100, [-0.2] * 8, 0), (300, copy, 0), (300, copy, 0), (2300, [0.4] * 8, 99)]
    return [(i, v, n, 1, 2, 3, 4) for i, v, n in rows]


def brute(rows: list[tuple], rule: hard_negatives.Rule) -> list[tuple]:
    used = [
        (i, [math.floor(256 * x) for x in v], n) for i, v, n, *_ in rows
        if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (anchor, left, label) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(left, right)), math.inf if i is None else i, i, n == label)
            for k, (i, right, n) in enumerate(used) if k != at
        ]
        scored.sort(key=lambda s: s[:2])
        for minus, _, positive, _ in [s for s in scored if s[3]][: rule.positives]:
            p = -minus
            near = [s for s in scored if not s[3] and rule.low * p <= -100 * s[0] <= rule.high * p]
            out += [(anchor, positive, r + 1, s[2], p, -s[0]) for r, s in enumerate(near[: rule.negatives])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table(spark):
    # Floats as the table holds them.
    return spark.createDataFrame(crafted(), SCHEMA).repartition(6).persist()


def mined(table, rule=hard_negatives.Rule()):
    anchor = F.col("vec_id") % 100 == 0
    return sorted(map(tuple, hard_negatives.mine(table, anchor, rule=rule).collect()), key=repr)


def test_like_plain_code(table):
    rows = [tuple(r) for r in table.collect()]
    expected = brute(rows, hard_negatives.Rule())
    assert len(expected) > 100
    assert mined(table) == expected


def test_small_blocks_that_meet_in_a_shuffle(table, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", 200)
    monkeypatch.setattr(hard_negatives, "MOST_BROADCAST", 0)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    rule = hard_negatives.Rule(positives=3, negatives=7, low=10, high=100)
    assert mined(table, rule) == brute([tuple(r) for r in table.collect()], rule)


def test_large_components_stay_exact(spark):
    rows = [(k * 100, [float((k + 1) * 1_000_003), -7.5 + k], k % 2, 0, 0, 0, 0) for k in range(12)]
    big = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert mined(big) == brute(rows, hard_negatives.Rule())


def test_an_empty_table_and_one_without_anchors(spark, table):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(table.filter("vec_id % 100 <> 0")) == []


def test_sorted_keys_are_in_the_order_of_their_parts():
    import numpy as np

    parts = [(3, -5, 0, 2), (3, 9, 1, -4), (3, 9, 0, 7), (3, 9, 0, None), (2, 0, 1, 0), (3, 9, 1, -9)]
    packed = [
        hard_negatives.keys(row, np.array([score]), other, np.array([id or 0]), np.array([id is None])).tobytes()
        for row, score, other, id in parts
    ]
    assert [hard_negatives.unpacked(k) for k in packed] == parts
    order = [p for _, p in sorted(zip(packed, parts))]
    assert order == [(2, 0, 1, 0), (3, 9, 0, 7), (3, 9, 0, None), (3, 9, 1, -9), (3, 9, 1, -4), (3, -5, 0, 2)]
