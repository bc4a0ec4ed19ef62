"""Two classifiers over character n-grams: a table of log-odds and a logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.functions.rows import unnest
from urlsight.functions.score import THRESHOLD
from urlsight.operators.corpus import class_weights
from urlsight.operators.features import WIDTHS, with_grams

TABLE_GRAM = 3
FEATURES = 1 << 18
CLIP = 1e-7


def train_table(corpus: DataFrame, width: int = TABLE_GRAM) -> DataFrame:
    """Readable model ``(gram, pos, neg, log_odds)`` from rows ``(url, label)``.

    ``pos`` and ``neg`` count the malicious and benign URLs that contain the n-gram; the
    log-odds use add-one smoothing. Classes are weighted alike, so there is no prior.
    """
    sizes = corpus.agg(F.struct(
        F.coalesce(F.sum("label"), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("neg"),
    )).scalar()
    grams = with_grams(corpus.select("url", "label"), widths=(width,))
    counted = unnest(grams.select("grams", "label"), "grams", "gram").groupBy("gram").agg(
        F.sum("label").cast("bigint").alias("pos"),
        F.sum(1 - F.col("label")).cast("bigint").alias("neg"),
    )
    rate_pos = (F.col("pos") + 1) / (sizes["pos"] + 2)
    rate_neg = (F.col("neg") + 1) / (sizes["neg"] + 2)
    return counted.withColumn("log_odds", F.log(rate_pos / rate_neg))


def save_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, pos bigint, neg bigint, log_odds double").parquet(path)


def _weighted(corpus: DataFrame) -> DataFrame:
    """Add the balanced class weight; there are as many weights as classes."""
    weight = F.lit(1.0)
    for row in class_weights(corpus).collect():
        weight = F.when(F.col("label") == row["label"], F.lit(row["weight"])).otherwise(weight)
    return corpus.withColumn("weight", weight)


def _hashing(features: int) -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)


def _regression(reg: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(weightCol="weight", regParam=reg, maxIter=max_iter)


def train(
    corpus: DataFrame,
    widths: tuple[int, ...] = WIDTHS,
    reg: float = 0.01,
    max_iter: int = 20,
    features: int = FEATURES,
) -> PipelineModel:
    """Logistic regression on the presence of hashed n-grams, classes weighted alike."""
    prepared = with_grams(_weighted(corpus), widths=widths)
    return Pipeline(stages=[_hashing(features), _regression(reg, max_iter)]).fit(prepared)


def _probability() -> Column:
    """Unrounded probability of the malicious class."""
    return F.get(vector_to_array(F.col("probability")), 1)


def predict(df: DataFrame, model: PipelineModel, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Add ``raw``, the unrounded probability of the malicious class."""
    scored = model.transform(with_grams(df, widths=widths))
    return scored.withColumn("raw", _probability()).select(*df.columns, "raw")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def validation_scores(scored: DataFrame) -> tuple[float, float]:
    """Log-loss and accuracy of held-out rows ``(label, raw)``."""
    p = F.least(F.greatest(F.col("raw"), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    hit = (F.col("raw") > THRESHOLD).cast("int") == F.col("label")
    row = scored.agg(
        F.avg(loss).alias("loss"), F.avg(hit.cast("int")).alias("accuracy")
    ).first()
    return row["loss"], row["accuracy"]


@dataclass
class Selection:
    """Outcome of ``select_model``: best by loss, best by accuracy, one row per round."""

    by_loss: PipelineModel
    by_accuracy: PipelineModel
    history: list[tuple[int, float, float, float]]


def select_model(
    training: DataFrame,
    validation: DataFrame,
    start_reg: float = 1.0,
    step: float = 10.0,
    max_rounds: int = 20,
    patience: int = 3,
    step_patience: int = 2,
    widths: tuple[int, ...] = WIDTHS,
    max_iter: int = 20,
    features: int = FEATURES,
) -> Selection:
    """Weaken the regularisation round by round while the validation loss falls.

    After ``step_patience`` rounds without a better loss the step is halved (on the log
    scale), after ``patience`` such rounds the search stops. Both parts are hashed to sparse
    vectors once and kept for all rounds; a lost executor's share is hashed again.
    """
    hashing = _hashing(features)

    def hashed(rows: DataFrame, *columns: str) -> DataFrame:
        return hashing.transform(with_grams(rows, widths=widths)).select(*columns, "features").persist()

    prepared = hashed(_weighted(training), "label", "weight")
    held_out = hashed(validation, "label")
    reg, best_loss, best_accuracy, stale, since_step = start_reg, float("inf"), -1.0, 0, 0
    by_loss = by_accuracy = None
    history = []
    try:
        for number in range(1, max_rounds + 1):
            fitted = _regression(reg, max_iter).fit(prepared)
            scored = fitted.transform(held_out).select("label", _probability().alias("raw"))
            loss, accuracy = validation_scores(scored)
            model = PipelineModel(stages=[hashing, fitted])
            history.append((number, reg, loss, accuracy))
            if accuracy > best_accuracy:
                best_accuracy, by_accuracy = accuracy, model
            if loss < best_loss:
                best_loss, by_loss, stale, since_step = loss, model, 0, 0
            else:
                stale, since_step = stale + 1, since_step + 1
                if stale >= patience:
                    break
                if since_step >= step_patience:
                    step, since_step = step ** 0.5, 0
            reg /= step
    finally:
        prepared.unpersist()
        held_out.unpersist()
    return Selection(by_loss, by_accuracy, history)
