"""Training in epochs of mini-batches."""

import random

import numpy as np
import pytest

from urlsight.operators import epochs


def urls(seed, count=400, share=0.5):
    draw = random.Random(seed)
    rows = []
    for _ in range(count):
        bad = draw.random() < share
        word = draw.choice(["login", "verify", "bonus"] if bad else ["garden", "library", "museum"])
        rows.append((f"http://{''.join(draw.choices('abcdefgh', k=6))}.org/{word}/{draw.randrange(99)}", int(bad)))
    return rows


@pytest.fixture(scope="module")
def sets(spark):
    shape = "url string, label int"
    return spark.createDataFrame(urls(1, share=0.2), shape), spark.createDataFrame(urls(2, 150), shape)


@pytest.mark.parametrize("part_rows", [200_000, 90])
def test_rows_are_learned_in_one_part_and_in_many(sets, part_rows):
    made = epochs.train_in_epochs(*sets, epochs=6, features=1 << 12, part_rows=part_rows)
    losses = [loss for _, loss, _ in made.history]
    assert 1 <= len(losses) <= 6 and losses[-1] < losses[0] < 0.69
    assert epochs.held_out_scores(epochs.predict(sets[1], made))[1] > 0.95


def test_a_run_is_repeatable_and_survives_saving(spark, sets, tmp_path):
    first, second = (epochs.train_in_epochs(*sets, epochs=2, features=1 << 10, part_rows=150) for _ in range(2))
    assert np.allclose(first.weights, second.weights)
    epochs.save_weights(spark, first, str(tmp_path / "weights"))
    back = epochs.load_weights(spark, str(tmp_path / "weights"))
    assert np.array_equal(back.weights, first.weights) and back.widths == first.widths


def test_training_stops_when_nothing_gets_better(spark, sets):
    noise = spark.createDataFrame([(u, random.Random(u).randint(0, 1)) for u, _ in urls(5, 100)], "url string, label int")
    made = epochs.train_in_epochs(sets[0], noise, patience=2, features=1 << 10)
    losses = [loss for _, loss, _ in made.history]
    assert len(losses) < epochs.EPOCHS
    assert losses.index(min(losses)) == len(losses) - 3


def test_null_urls_empty_sets_and_other_columns(spark, sets):
    shape = "url string, label int, features string, raw2 int"
    odd = spark.createDataFrame([(None, 1, "f", 1), ("", 0, None, 2), ("http://a.org/login", 1, "g", 3)], shape)
    made = epochs.train_in_epochs(odd.select("url", "label"), odd.select("url", "label").limit(0), epochs=2, features=1 << 8)
    assert len(made.history) == 2
    scored = epochs.predict(odd.drop("features"), made)
    assert scored.columns == ["url", "label", "raw2", "raw"]
    assert all(0 < r["raw"] < 1 for r in scored.collect())
    empty = odd.select("url", "label").limit(0)
    assert not epochs.train_in_epochs(empty, empty, epochs=2, features=1 << 8).weights.any()


def test_a_mini_batch_goes_down_the_gradient():
    draw = np.random.default_rng(3)
    bounds, values = np.array([0, 3, 3, 7, 9]), draw.integers(0, 20, 9)
    labels, weight = np.array([1.0, 0, 1, 0]), np.array([2.0, 1, 1, 3])
    weights = draw.normal(size=21) / 5

    def loss(w):
        p = epochs.probabilities(epochs.margins(w, bounds, values))
        return float((weight * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / len(labels))

    steps = epochs.Steps(weights, np.full(21, 1e9), rate=1.0, penalty=0.0)
    steps.take(bounds, values, labels, weight)
    slope = (weights - steps.weights) * np.sqrt(1e9)
    for k in range(21):
        shift = np.zeros(21)
        shift[k] = 1e-6
        assert abs((loss(weights + shift) - loss(weights - shift)) / 2e-6 - slope[k]) < 1e-4
