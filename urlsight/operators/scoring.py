"""Scoring URLs with any of the models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.functions.rows import unnest
from urlsight.functions.score import THRESHOLD, label_score, round_score
from urlsight.functions.text import model_text, normalize_url, spaced_characters
from urlsight.operators.features import with_grams
from urlsight.operators.model import TABLE_GRAM, predict

BROADCAST_ROWS = 200_000

@dataclass(frozen=True)
class TableModel:
    """A log-odds table whose size is known, loaded once for all batches that it scores.

    ``score`` is the row-wise form: a function of the URL column with the n-grams of a table of
    up to ``BROADCAST_ROWS`` rows in it. Of a larger table there is none, and the frequent
    n-grams are apart: with T occurrences in training at most ``BROADCAST_ROWS`` n-grams occur
    ``T / BROADCAST_ROWS`` times.
    """

    table: DataFrame
    seen: int
    broadcast_rows: int
    score: Callable[[Column], Column] | None


Model = PipelineModel | DataFrame | TableModel | Callable[[Column], Column]


def table_model(table: DataFrame, width: int = TABLE_GRAM, broadcast_rows: int = BROADCAST_ROWS) -> TableModel:
    """Read the size of a stored table, and its n-grams if there are few."""
    size = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("seen"),
    ).first()
    score = None
    if size["rows"] <= broadcast_rows:
        weights = {row["gram"]: row["log_odds"] for row in table.select("gram", "log_odds").collect()}
        score = _gram_scorer(table.sparkSession, weights, width)
    return TableModel(table, size["seen"], broadcast_rows, score)


def _gram_scorer(spark: SparkSession, weights: dict[str, float], width: int) -> Callable[[Column], Column]:
    """The probability of a URL's text from the sum over its distinct n-grams, row by row."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value

        def total(text: str | None) -> float:
            text = text or ""
            grams = {text[i: i + width] for i in range(len(text) - width + 1)}
            return math.fsum(known[g] for g in grams if g in known)

        for texts in batches:
            sums = np.array([total(text) for text in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-sums)))

    return lambda url: probabilities(model_text(normalize_url(url)))


def _log_odds(grams: DataFrame, model: TableModel) -> DataFrame:
    """``(url, log_odds)`` for every known n-gram of ``(url, gram)`` of a large table.

    The frequent n-grams are broadcast, the rare rest is joined by shuffle, and there no key
    is hot.
    """
    table = model.table
    is_hot = (F.col("pos") + F.col("neg")) * model.broadcast_rows >= F.lit(model.seen)
    hot = table.filter(is_hot).select("gram", "log_odds")
    cold = table.filter(~is_hot).select("gram", "log_odds")
    tried = grams.join(F.broadcast(hot), "gram", "left")
    frequent = tried.filter(F.col("log_odds").isNotNull()).select("url", "log_odds")
    rare = tried.filter(F.col("log_odds").isNull()).select("url", "gram")
    return frequent.unionByName(rare.join(cold, "gram").select("url", "log_odds"))


def score_with_table(df: DataFrame, table: DataFrame | TableModel, width: int = TABLE_GRAM) -> DataFrame:
    """Add ``raw`` from a log-odds table: the logistic function of the sum over n-grams.

    With a table that fits in memory every row is scored by itself, without a shuffle. A larger
    one is joined: each distinct URL is scored once, and copies, however many, only meet again
    in the last join. The sums go through a shuffle of their own before that join: adaptive
    execution splits the rows of a hot URL only where both sides of a join come straight from a
    shuffle. The planner would save that shuffle, since the sums are partitioned by URL already,
    so the key is written as a new expression.
    """
    model = table if isinstance(table, TableModel) else table_model(table, width)
    if model.score is not None:
        return df.withColumn("raw", model.score(F.col("url")))
    urls = df.select("url").distinct()
    grams = unnest(with_grams(urls, widths=(width,)), "grams", "gram")
    sums = _log_odds(grams, model).groupBy("url").agg(F.sum("log_odds").alias("_sum"))
    sums = sums.select(F.concat("url", F.lit("")).alias("url"), "_sum")
    return (
        df.join(sums, "url", "left")
        .withColumn("raw", 1 / (1 + F.exp(-F.coalesce("_sum", F.lit(0.0)))))
        .select(*df.columns, "raw")
    )


def with_raw_score(df: DataFrame, model: Model) -> DataFrame:
    """Add ``raw`` with a fitted pipeline, a log-odds table, or a function of the URL column.

    ``batch_scorer`` makes such a function of a user's own model.
    """
    if isinstance(model, DataFrame | TableModel):
        return score_with_table(df, model)
    if isinstance(model, PipelineModel):
        return predict(df, model)
    return df.withColumn("raw", model(F.col("url")))


def batch_scorer(load: Callable[[], Callable[[list[str]], Sequence[float]]]) -> Callable[[Column], Column]:
    """A scoring function around a user's own model, as ``score_urls`` takes it.

    ``load`` runs once per Python worker and returns what predicts a batch: it gets the
    normalised URLs with their characters set apart by blanks and gives one probability
    each. The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    @F.pandas_udf("float")
    def predict_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict_batch = load()
        for texts in batches:
            yield pd.Series(predict_batch(texts.tolist()), dtype="float32")

    return lambda url: predict_batches(spaced_characters(normalize_url(url))).cast("double")


def classify(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Class from the raw score, then the rounded score that is stored."""
    return (
        scored.withColumn("classification", label_score(F.col("raw"), threshold))
        .withColumn("score", round_score(F.col("raw")))
        .drop("raw")
    )


def score_urls(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of the classified table: URL, stored score, class and time."""
    scored = classify(with_raw_score(df.select("url"), model), threshold)
    return scored.select("url", "score", "classification", F.current_timestamp().alias("time_added"))
