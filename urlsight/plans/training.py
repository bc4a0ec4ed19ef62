"""The whole offline run: labelled lists in, model and evaluation reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.operators import corpus, model
from urlsight.plans import evaluation
from urlsight.schemas import LABELLED
from urlsight.sinks.reports import write_csv_report
from urlsight.sources.lines import read_labelled_lines


def _only(split: DataFrame, part: str) -> DataFrame:
    return split.filter(F.col("part") == part).drop("part")


def write_reports(predictions: DataFrame, out: str) -> DataFrame:
    """Metric and summary tables of rows ``(url, truth, score)`` as CSV; returns the metrics.

    The one-row metrics are stored first, so both tables come from one pass over the rows.
    """
    measured = f"{out}/measured"
    evaluation.metrics(predictions).write.mode("overwrite").parquet(measured)
    metrics = predictions.sparkSession.read.parquet(measured)
    write_csv_report(evaluation.metrics_table(metrics), f"{out}/model_metrics")
    write_csv_report(evaluation.summary(metrics), f"{out}/evaluation_summary")
    return metrics


def train_and_evaluate(
    spark: SparkSession, labels: dict[str, int], out: str, seed: int = 42, **search
) -> DataFrame:
    """Read, de-duplicate, balance, split, search a model, score the test part, report.

    ``out`` receives ``corpus``, ``model``, ``best_accuracy_model``, ``predictions`` and
    the reports. The corpus and the predictions are stored because several passes follow;
    after a lost executor they are read again instead of being computed anew.
    """
    corpus.dedup_corpus(read_labelled_lines(spark, labels)).write.mode("overwrite").parquet(
        f"{out}/corpus"
    )
    rows = spark.read.schema(LABELLED).parquet(f"{out}/corpus")
    split = corpus.balance_split(rows, seed=seed)
    parts = corpus.stratified_split(_only(split, corpus.TRAIN), seed=seed)
    chosen = model.select_model(
        _only(parts, corpus.TRAIN), _only(parts, corpus.VALIDATION), **search
    )
    model.save_model(chosen.by_loss, f"{out}/model")
    model.save_model(chosen.by_accuracy, f"{out}/best_accuracy_model")
    model.predict(_only(split, corpus.TEST), chosen.by_loss).select(
        "url", F.col("label").alias("truth"), F.col("raw").alias("score")
    ).write.mode("overwrite").parquet(f"{out}/predictions")
    return write_reports(spark.read.parquet(f"{out}/predictions"), out)
