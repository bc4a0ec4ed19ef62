"""The labelled corpus: union, duplicates, balance, splits, weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.functions.rows import computed_once
from urlsight.operators.ranking import hash_key, key_at_rank, with_position

TRAIN, TEST, VALIDATION = "train", "test", "validation"


def union_corpus(benign: DataFrame, malicious: DataFrame) -> DataFrame:
    """Both classes in one frame, repeats kept."""
    return benign.unionByName(malicious)


def dedup_corpus(corpus: DataFrame) -> DataFrame:
    """One row per URL. A URL of both classes stays benign: benign rows come first.

    The minimum label says the same as "first row wins" and does not depend on row order.
    """
    return corpus.groupBy("url").agg(F.min("label").alias("label"))


def dedup_report(corpus: DataFrame) -> DataFrame:
    """Rows before, rows after and rows removed."""
    per_url = corpus.groupBy("url").agg(F.count(F.lit(1)).alias("copies"))
    return per_url.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("before"),
        F.count(F.lit(1)).alias("after"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count(F.lit(1))).alias("removed"),
    )


def class_counts(corpus: DataFrame) -> DataFrame:
    """Rows per class."""
    return corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _counts(corpus: DataFrame) -> dict[int, int]:
    return {row["label"]: row["n"] for row in class_counts(corpus).collect()}


def _upto(cuts: dict[tuple, str], sizes: dict[int, int] | int, key: Column) -> Column:
    """The key is not beyond the cut that leaves ``sizes`` rows of its class."""
    inside = F.lit(False)
    for (label, rank), cut in cuts.items():
        if rank == (sizes if isinstance(sizes, int) else sizes[label]):
            inside = inside | ((F.col("label") == label) & (key <= F.lit(cut)))
    return inside


def balance_split(corpus: DataFrame, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Equally many rows of each class, parted into ``train`` and ``test``.

    With N the size of the smaller class, ``int(train * N)`` rows per class go to train
    and the other ``N - int(train * N)`` to test. Membership follows from the URL's hash,
    so it cannot drift between runs, and the split itself is a filter on literals: no
    sort, no shuffle, no anti-join. URLs must be distinct (``dedup_corpus``).
    """
    counts = _counts(corpus)
    size = min(counts.get(0, 0), counts.get(1, 0))
    keyed = computed_once(corpus, "_key", hash_key(seed))
    key = F.col("_key")
    train_size = int(size * train)
    wanted = {(label, rank) for label in (0, 1) for rank in (train_size, size)}
    cuts = key_at_rank(keyed, key, "label", sorted(wanted))
    part = F.when(_upto(cuts, train_size, key), F.lit(TRAIN)).when(
        _upto(cuts, size, key), F.lit(TEST)
    )
    return keyed.withColumn("part", part).filter(F.col("part").isNotNull()).drop("_key")


def train_sizes(counts: dict[int, int], fraction: float) -> dict[int, int]:
    """Rows per class that stay in training when ``fraction`` of all rows are held out.

    The held-out number is rounded up, the rest is shared out in proportion, and what
    rounding leaves over goes to the largest remainders, to the lower label on ties.
    """
    total = sum(counts.values())
    kept = total - math.ceil(fraction * total)
    exact = {label: n / total * kept for label, n in counts.items()}
    sizes = {label: math.floor(x) for label, x in exact.items()}
    by_remainder = sorted(counts, key=lambda label: (sizes[label] - exact[label], label))
    for label in by_remainder[: kept - sum(sizes.values())]:
        sizes[label] += 1
    return sizes


def stratified_split(corpus: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``train`` and ``validation`` with the classes in proportion; URLs must be distinct."""
    counts = _counts(corpus)
    keyed = computed_once(corpus, "_key", hash_key(seed))
    key = F.col("_key")
    sizes = train_sizes(counts, fraction)
    cuts = key_at_rank(keyed, key, "label", sorted(sizes.items()))
    part = F.when(_upto(cuts, sizes, key), F.lit(TRAIN)).otherwise(F.lit(VALIDATION))
    return keyed.withColumn("part", part).drop("_key")


def shuffle_corpus(corpus: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in a random order, the same for the same seed, with their ``position`` from 1.

    URLs must be distinct, and the corpus stored: it is read twice.
    """
    return with_position(corpus, hash_key(seed)).orderBy("position")


def class_weights(corpus: DataFrame) -> DataFrame:
    """Balanced weights ``rows / (classes * rows of the class)``."""
    counts = class_counts(corpus)
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count("n").alias("classes"))).scalar()
    return counts.select(
        "label", "n", (whole["n"] / (whole["classes"] * F.col("n"))).alias("weight")
    )
