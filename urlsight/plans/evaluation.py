"""Evaluation of a classifier over rows ``(url, truth, score)``; truth is 0 or 1.

Predictions are ``score > threshold``; only the threshold sweep compares with ``>=``.
Rows are first counted per distinct score, so one score that fills a third of the table
is one row afterwards, and all ranks come from ``running_totals``.

A row without a score (NULL or NaN) is not flagged. Where scores are ranked it comes below all others, as
minus infinity (its threshold is shown as NULL), and its loss is that of the score 0. Figures
of the scores themselves (histogram, boxes, mean scores) leave it out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsight.functions.score import THRESHOLD
from urlsight.functions.text import url_prefix
from urlsight.operators.ranking import running_totals, value_bounds
from urlsight.session import stored

CLIP = 1e-7
BINS = 60
EXAMPLES = 5

# Row names of the summary table and of the per-class report.
SUMMARY_ROWS = (
    ("Tổng Số Mẫu", "total"),
    ("URL Sạch (Thực Tế)", "negatives"),
    ("URL Độc Hại (Thực Tế)", "positives"),
    ("True Positives", "tp"),
    ("True Negatives", "tn"),
    ("False Positives", "fp"),
    ("False Negatives", "fn"),
)
CLASS_NAMES = ("Sạch (0)", "Độc hại (1)")
METRIC_ROWS = (
    ("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"),
    ("F1-Score", "f1"), ("AUC-ROC", "auc_roc"), ("Average Precision", "average_precision"),
)


def _ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def with_missing_scores(df: DataFrame) -> DataFrame:
    """The rows with NaN scores turned into NULL, so that both are a missing score everywhere."""
    return df.withColumn("score", F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double")))


def confusion(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row ``tn, fp, fn, tp``."""
    df = with_missing_scores(df)
    flagged = F.coalesce(F.col("score") > F.lit(threshold), F.lit(False))
    positive = F.col("truth") == 1
    return df.agg(
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(positive & flagged).alias("tp"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of rows ``tn, fp, fn, tp``."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


NO_SCORE = float("-inf")


def score_counts(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score; rows without one are counted at ``NO_SCORE``."""
    return with_missing_scores(df).groupBy(F.coalesce(F.col("score"), F.lit(NO_SCORE)).alias("score")).agg(
        F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg")
    )


@dataclass(frozen=True)
class Counted:
    """Stored counts per distinct score, and the bounds by which they are ranked.

    The rows of a table are read once for it; metrics and both curves come from it.
    """

    counts: DataFrame
    bounds: list[float]

    def ranked(self) -> DataFrame:
        return running_totals(self.counts, "score", ["pos", "neg"], bounds=self.bounds)

    def sizes(self) -> Column:
        return self.counts.agg(F.struct(
            F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"),
            F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"),
        )).scalar()


def counted(df: DataFrame | Counted, bounds: list[float] | None = None) -> Counted:
    """Count the rows ``(truth, score)``; ``bounds`` follow from the distinct scores if not given."""
    if isinstance(df, Counted):
        return df
    counts = stored(score_counts(df), "score-counts")
    return Counted(counts, value_bounds(counts, "score") if bounds is None else bounds)


def _shown(score: Column) -> Column:
    return F.nullif(score, F.lit(NO_SCORE))


def metrics(
    df: DataFrame | Counted, threshold: float = THRESHOLD, bounds: list[float] | None = None
) -> DataFrame:
    """One row with the confusion counts, the four rates, ROC-AUC, average precision and loss.

    All of it comes from one pass over the distinct scores. ROC-AUC counts for each
    positive the negatives below it, ties half; the loss is clipped like the trainer's.
    """
    score, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    p = F.least(F.greatest(score, F.lit(CLIP)), F.lit(1 - CLIP))
    flagged = score > F.lit(threshold)

    def total(amount: Column) -> Column:
        return F.coalesce(F.sum(amount), F.lit(0))

    sums = counted(df, bounds).ranked().agg(
        total(F.when(flagged, 0).otherwise(neg)).alias("tn"),
        total(F.when(flagged, neg).otherwise(0)).alias("fp"),
        total(F.when(flagged, 0).otherwise(pos)).alias("fn"),
        total(F.when(flagged, pos).otherwise(0)).alias("tp"),
        F.sum(pos * (cum_neg - neg / 2)).alias("negatives_above"),
        F.sum(pos * cum_pos / (cum_pos + cum_neg)).alias("precision_sum"),
        F.sum(-pos * F.log(p) - neg * F.log(1 - p)).alias("loss_sum"),
    )
    positives = (F.col("tp") + F.col("fn")).cast("double")
    negatives = (F.col("tn") + F.col("fp")).cast("double")
    auc = F.try_divide(positives * negatives - F.col("negatives_above"), positives * negatives)
    return rates(sums).select(
        "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1",
        auc.alias("auc_roc"),
        _ratio(F.col("precision_sum"), positives).alias("average_precision"),
        F.try_divide(F.col("loss_sum"), positives + negatives).alias("loss"),
    )


def _long(row: DataFrame, names: tuple[tuple[str, str], ...], key: str, value: str) -> DataFrame:
    """A one-row frame turned into one named row per column."""
    entries = [F.struct(F.lit(n).alias(key), F.col(c).alias(value)) for n, c in names]
    return row.select(F.explode(F.array(*entries)).alias("_entry")).select("_entry.*")


def metrics_table(measured: DataFrame) -> DataFrame:
    """``(Metric, Value)`` with four decimals, as saved to CSV, from ``metrics``."""
    rows = _long(measured, METRIC_ROWS, "Metric", "Value")
    return rows.withColumn("Value", F.format_string("%.4f", "Value"))


def compare(measured: DataFrame) -> DataFrame:
    """``(Metric, Score)`` of the four threshold metrics."""
    return _long(measured, METRIC_ROWS[:4], "Metric", "Score")


def summary(counts: DataFrame) -> DataFrame:
    """``(Category, Count)``: rows, rows per true class and the confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    whole = counts.select(
        "*",
        (tn + fp + fn + tp).alias("total"),
        (tn + fp).alias("negatives"),
        (fn + tp).alias("positives"),
    )
    return _long(whole, SUMMARY_ROWS, "Category", "Count")


def class_report(counts: DataFrame, names: tuple[str, str] = CLASS_NAMES) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    figures = ("precision", "recall", "f1")
    benign = {"precision": _ratio(tn, tn + fn), "recall": _ratio(tn, tn + fp), "f1": _f1(tn, fn, fp)}
    malicious = {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _f1(tp, fp, fn)}
    n0, n1 = tn + fp, tp + fn
    accuracy = _ratio(tp + tn, n0 + n1)

    def entry(name: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), *[values[f].alias(f) for f in figures],
            support.alias("support"),
        )

    macro = {f: (benign[f] + malicious[f]) / 2 for f in figures}
    weighted = {f: _ratio(benign[f] * n0 + malicious[f] * n1, n0 + n1) for f in figures}
    entries = [
        entry(names[0], benign, n0),
        entry(names[1], malicious, n1),
        entry("accuracy", dict.fromkeys(figures, accuracy), n0 + n1),
        entry("macro avg", macro, n0 + n1),
        entry("weighted avg", weighted, n0 + n1),
    ]
    return counts.select(F.explode(F.array(*entries)).alias("_entry")).select("_entry.*")


def roc_curve(
    df: DataFrame | Counted, drop_collinear: bool = True, bounds: list[float] | None = None, thinned: bool = False
) -> DataFrame:
    """ROC points ``(fpr, tpr, threshold)`` from (0, 0) to (1, 1), one per distinct score.

    With ``drop_collinear`` a point goes if the next step has the same slope and length;
    the first and the last stay. With ``thinned`` it goes if the next step has the same slope,
    however long, so that only the corners of the curve are left. The next step is that of the
    following score, in the following bucket if need be, and slopes are compared as whole products.
    """
    found = counted(df, bounds)
    sizes, ranked = found.sizes(), found.ranked()
    if thinned:
        pos, neg, next_pos, next_neg = (
            F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "next_pos", "next_neg")
        )
        ranked = ranked.filter(F.col("next_pos").isNull() | (pos * next_neg != neg * next_pos))
    elif drop_collinear:
        is_first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        ranked = ranked.filter(is_first | F.col("next_pos").isNull() | bends)
    points = ranked.select(
        F.try_divide(F.col("cum_neg").cast("double"), sizes["neg"]).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), sizes["pos"]).alias("tpr"),
        _shown(F.col("score")).alias("threshold"),
    )
    start = found.counts.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(start)


def pr_curve(
    df: DataFrame | Counted, bounds: list[float] | None = None, thinned: bool = False
) -> DataFrame:
    """``(precision, recall, threshold)`` per distinct score, and the end point (1, 0).

    With ``thinned`` a point goes if it lies on an upright line between its neighbours: neither
    its own score nor the next one has positives, so all three have the same recall.
    """
    found = counted(df, bounds)
    sizes = found.sizes()
    cum_pos, cum_neg = F.col("cum_pos"), F.col("cum_neg")
    ranked = found.ranked()
    if thinned:
        ranked = ranked.filter(F.col("next_pos").isNull() | (F.col("pos") > 0) | (F.col("next_pos") > 0))
    points = ranked.select(
        _ratio(cum_pos, cum_pos + cum_neg).alias("precision"),
        F.coalesce(F.try_divide(cum_pos.cast("double"), sizes["pos"]), F.lit(1.0)).alias("recall"),
        _shown(F.col("score")).alias("threshold"),
    )
    end = found.counts.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return points.unionByName(end)


def thresholds(start: float = 0.1, stop: float = 1.0, step: float = 0.02) -> list[float]:
    return np.arange(start, stop, step).tolist()


def threshold_sweep(
    df: DataFrame, start: float = 0.1, stop: float = 1.0, step: float = 0.02
) -> DataFrame:
    """Counts and rates for every threshold, with ``score >= threshold`` as the prediction.

    One scan counts the rows per number of thresholds they reach; the rest is a running
    total over one row per threshold. The number is guessed by division and put right by
    comparing with the two thresholds next to the guess, so it is exact.
    """
    limits = thresholds(start, stop, step)
    steps = len(limits)
    score = F.col("score")
    padded = F.array(*[F.lit(t) for t in [*limits, float("inf"), float("inf")]])
    guess = F.least(F.greatest(F.floor((score - start) / step), F.lit(0)), F.lit(steps)).cast("int")
    exact = (
        guess
        + (score >= F.get(padded, guess)).cast("int")
        + (score >= F.get(padded, guess + 1)).cast("int")
    )
    reached = F.coalesce(exact, F.lit(0))
    counted = with_missing_scores(df).groupBy(reached.alias("reached")).agg(
        F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg")
    )
    grid = F.posexplode(F.array(*[F.lit(t) for t in [0.0, *limits]])).alias("reached", "threshold")
    spine = df.sparkSession.range(1).select(grid)
    above = Window.orderBy(F.col("reached").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    pos, neg = F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0))
    counts = (
        spine.join(counted, "reached", "left")
        .select(
            "reached", "threshold",
            F.sum(pos).over(above).alias("tp"), F.sum(neg).over(above).alias("fp"),
            F.sum(pos).over(whole).alias("_pos"), F.sum(neg).over(whole).alias("_neg"),
        )
        .filter(F.col("reached") > 0)
        .select(
            "threshold", (F.col("_neg") - F.col("fp")).alias("tn"), "fp",
            (F.col("_pos") - F.col("tp")).alias("fn"), "tp",
        )
    )
    return rates(counts).orderBy("threshold")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the lowest one among equals."""
    return sweep.orderBy(F.col("f1").desc(), "threshold").limit(1)


def _outcome(threshold: float) -> Column:
    flagged = F.coalesce(F.col("score") > F.lit(threshold), F.lit(False))
    return (
        F.when(flagged & (F.col("truth") == 1), "TP")
        .when(flagged, "FP")
        .when(F.col("truth") == 1, "FN")
        .otherwise("TN")
    )


def error_stats(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Count and mean score of the false positives and of the false negatives."""
    return (
        with_missing_scores(df).select(_outcome(threshold).alias("kind"), "score")
        .filter(F.col("kind").isin("FP", "FN"))
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    )


def error_examples(df: DataFrame, threshold: float = THRESHOLD, k: int = EXAMPLES) -> DataFrame:
    """The first ``k`` errors of each kind by score and URL, URLs cut for display.

    Two top-k selections; ranking all errors of a kind in a window would sort them in one
    task.
    """
    kinds = with_missing_scores(df).select(_outcome(threshold).alias("kind"), "score", "url")
    first = [
        kinds.filter(F.col("kind") == kind).orderBy("score", "url").limit(k) for kind in ("FP", "FN")
    ]
    return first[0].unionByName(first[1]).select("kind", "score", url_prefix(F.col("url")).alias("url"))


def score_histogram(df: DataFrame, bins: int = BINS) -> DataFrame:
    """``bins`` equal bins per class over the class's own score range, the last one closed.

    Empty bins are listed. The four ends of the ranges are read first and stand in the
    plan as numbers. The bin is found by division and put right by comparing with its
    edges.
    """
    scored = with_missing_scores(df).select("truth", "score").filter(
        F.col("score").isNotNull() & F.col("truth").isin(0, 1)
    )
    ends = []
    for truth in (0, 1):
        of_class = F.when(F.col("truth") == truth, F.col("score"))
        ends += [F.min(of_class), F.max(of_class)]
    lo0, hi0, lo1, hi1 = scored.agg(*ends).first()
    ranges = [_widened(lo0, hi0), _widened(lo1, hi1)]

    def of_class(values: list[float | None]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("truth"))

    score, lo, hi = F.col("score"), of_class([r[0] for r in ranges]), of_class([r[1] for r in ranges])
    width = of_class([None if r[0] is None else (r[1] - r[0]) / bins for r in ranges])

    def edge(place: Column) -> Column:
        return F.when(place >= bins, hi).otherwise(lo + place * width)

    guess = F.least(F.floor((score - lo) / width), F.lit(bins - 1))
    bin_of = (
        F.col("_guess")
        - (score < edge(F.col("_guess"))).cast("int")
        + ((score >= edge(F.col("_guess") + 1)) & (F.col("_guess") < bins - 1)).cast("int")
    )
    counted = (
        scored.withColumn("_guess", guess)
        .groupBy("truth", bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spine = df.sparkSession.range(2 * bins).select(
        F.floor(F.col("id") / bins).cast("int").alias("truth"), (F.col("id") % bins).alias("bin")
    )
    listed = spine.filter(lo.isNotNull())
    return listed.join(counted, ["truth", "bin"], "left").select(
        "truth", "bin",
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _widened(lo: float | None, hi: float | None) -> tuple[float | None, float | None]:
    """A range of one single score is widened by a half on either side."""
    return (lo - 0.5, hi + 0.5) if lo is not None and lo == hi else (lo, hi)


def box_stats(
    df: DataFrame, threshold: float = THRESHOLD, bounds: list[float] | None = None
) -> DataFrame:
    """Box-plot figures of the scores per outcome: quartiles, whiskers, mean and notch.

    Quartiles are exact, with linear interpolation. They are read off running counts over
    the distinct scores, which are stored, so no outcome's scores are gathered in one task.
    """
    scored = with_missing_scores(df).filter(F.col("score").isNotNull())
    counts = stored(
        scored.groupBy(_outcome(threshold).alias("outcome"), "score").agg(F.count(F.lit(1)).alias("n")),
        "outcome-counts",
    )
    if bounds is None:
        bounds = value_bounds(counts, "score")
    ranked = running_totals(counts, "score", ["n"], by=["outcome"], bounds=bounds, descending=False)
    sizes = counts.groupBy("outcome").agg(
        F.sum("n").alias("size"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean")
    )
    # Zero-based places of the quartiles; a score covers the places from cum_n - n on.
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}

    def place(q: float) -> Column:
        return (F.col("size") - 1) * F.lit(q)

    def at(position: Column) -> Column:
        here = (F.col("cum_n") - F.col("n") <= position) & (position < F.col("cum_n"))
        return F.max(F.when(here, F.col("score")))

    ends = []
    for name, q in quarters.items():
        ends += [at(F.floor(place(q))).alias(f"{name}_lo"), at(F.ceil(place(q))).alias(f"{name}_hi")]
    placed = ranked.join(F.broadcast(sizes), "outcome").groupBy("outcome", "size", "mean").agg(*ends)
    quartiles = placed.select(
        "outcome", "size", "mean",
        *[
            (
                F.col(f"{name}_lo")
                + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place(q) - F.floor(place(q)))
            ).alias(name)
            for name, q in quarters.items()
        ],
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    score, iqr = F.col("score"), F.col("iqr")
    reach = counts.join(F.broadcast(quartiles), "outcome").groupBy(*quartiles.columns).agg(
        F.sum("n").alias("n"),
        F.min(F.when(score >= F.col("q1") - 1.5 * iqr, score)).alias("low"),
        F.max(F.when(score <= F.col("q3") + 1.5 * iqr, score)).alias("high"),
    )
    notch = 1.57 * iqr / F.sqrt("size")
    return reach.select(
        "outcome", "n", "mean", "q1", "median", "q3",
        F.least(F.coalesce("low", "q1"), F.col("q1")).alias("whisker_low"),
        F.greatest(F.coalesce("high", "q3"), F.col("q3")).alias("whisker_high"),
        (F.col("median") - notch).alias("notch_low"),
        (F.col("median") + notch).alias("notch_high"),
    )
