"""Dashboard and evaluation on small tables, against numpy and written-out sums."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsight.plans import dashboard, evaluation
from urlsight.plans.training import train_and_evaluate
from urlsight.schemas import CLASSIFIED


def table(spark, rows):
    return spark.createDataFrame(rows, CLASSIFIED)


NOW = datetime(2024, 1, 8, 12)


def test_empty_table(spark):
    empty = table(spark, [])
    assert tuple(dashboard.stats(empty).first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0, 0, 0.0)
    assert tuple(dashboard.realtime(empty, NOW).first()) == (0, 0, None)
    for query in (dashboard.confidence, dashboard.top_domains, dashboard.url_length, dashboard.recent,
                  dashboard.top_malicious):
        assert query(empty).count() == 0
    assert dashboard.timeline(empty, NOW).count() == 0
    assert dashboard.detection_rate(empty, NOW).count() == 0


ROWS = [
    ("http://a.com/1", 0.5, "MALICIOUS", datetime(2024, 1, 8, 11, 30)),
    ("http://a.com/2", 0.9, "MALICIOUS", datetime(2024, 1, 8, 11, 30, 30)),
    ("///", 0.8, "MALICIOUS", datetime(2024, 1, 8, 11, 0)),
    ("https://www.b.org", 0.31, "BENIGN", datetime(2024, 1, 8, 13, 0)),
    ("https://www.b.org", 0.3, "BENIGN", datetime(2024, 1, 1, 12, 0)),
    ("https://www.b.org", 0.05, "BENIGN", datetime(2024, 1, 1, 11, 59, 59)),
    (None, None, "BENIGN", datetime(2024, 1, 2)),
]


def test_stats(spark):
    row = dashboard.stats(table(spark, ROWS)).first()
    assert (row.total_urls, row.total_malicious, row.total_benign) == (7, 3, 4)
    assert (row.malicious_rate, row.benign_rate) == (42.86, 57.14)
    assert (row.avg_malicious_confidence, row.avg_benign_confidence) == (0.733, 0.22)
    assert (row.low_confidence_malicious, row.low_confidence_benign) == (1, 1)
    assert row.false_positive_rate == 14.29


def test_time_windows_have_a_lower_bound_only(spark):
    df = table(spark, ROWS)
    assert tuple(dashboard.realtime(df, NOW).first()) == (4, 3, datetime(2024, 1, 8, 13))
    assert [tuple(r) for r in dashboard.timeline(df, NOW).collect()] == [
        (datetime(2024, 1, 8, 11, 30), 1, 2), (datetime(2024, 1, 8, 13), 0, 1),
    ]
    assert [(str(r.date), r.detection_rate, r.total_urls) for r in dashboard.detection_rate(df, NOW).collect()] == [
        ("2024-01-01", 0.0, 1), ("2024-01-02", 0.0, 1), ("2024-01-08", 75.0, 4),
    ]


def test_groups_and_tops(spark):
    df = table(spark, ROWS)
    assert [tuple(r) for r in dashboard.top_domains(df).collect()] == [("a.com", 2, 0.7)]
    assert [tuple(r) for r in dashboard.confidence(df).collect()] == [
        (0, "0.3-0.5", 2), (0, "0.0-0.1", 2), (1, "0.9-1.0", 1), (1, "0.7-0.9", 1), (1, "0.5-0.7", 1),
    ]
    assert [tuple(r) for r in dashboard.url_length(df).collect()] == [
        ("0-30", 0, 3), ("0-30", 1, 3), ("100+", 0, 1),
    ]
    newest = dashboard.recent(df, k=3).collect()
    assert [r.timestamp for r in newest] == sorted(r[3] for r in ROWS)[-3:]
    assert dashboard.recent(df).filter("url is null").first().score == 0.0
    assert [r.confidence for r in dashboard.top_malicious(df, k=2).collect()] == [0.9, 0.8]


def test_top_domains_combines_before_the_shuffle(spark):
    hot = spark.range(5000).select(
        F.lit("http://hot.com/x").alias("url"), F.lit(0.9).alias("score"),
        F.lit("MALICIOUS").alias("classification"), F.lit(NOW).alias("time_added"),
    )
    top = dashboard.top_domains(hot)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "TakeOrderedAndProject" in plan
    assert [tuple(r)[:2] for r in top.collect()] == [("hot.com", 5000)]


# ------------------------------------------------------------------ evaluation


def sample(n=400, digits=2, seed=3):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 2, n)
    score = np.clip(rng.normal(0.35 + 0.3 * truth, 0.25), 0, 1).round(digits)
    return truth, score


def frame(spark, truth, score):
    rows = [(f"u{i:04d}", int(t), float(s)) for i, (t, s) in enumerate(zip(truth, score))]
    return spark.createDataFrame(rows, "url string, truth int, score double")


BOUNDS = [[], [0.2, 0.5, 0.51], [float(b) for b in np.arange(0.03, 1, 0.07)]]


def test_published_counts(spark):
    # The published confusion counts and the four rates that go with them.
    counts = spark.createDataFrame([(691309, 5700, 18527, 678482)], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = evaluation.rates(counts).first()
    assert [round(row[c], 4) for c in ("accuracy", "precision", "recall", "f1")] == [
        0.9826, 0.9917, 0.9734, 0.9825,
    ]
    summary = [tuple(r) for r in evaluation.summary(counts).collect()]
    assert [n for _, n in summary] == [1394018, 697009, 697009, 678482, 691309, 5700, 18527]


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("digits", [1, 2, 9])
def test_metrics(spark, bounds, digits):
    truth, score = sample(digits=digits)
    row = evaluation.metrics(frame(spark, truth, score), bounds=bounds).first()
    flagged = score > 0.5
    assert (row.tp, row.fp) == (np.sum(flagged & (truth == 1)), np.sum(flagged & (truth == 0)))
    positive, negative = score[truth == 1], score[truth == 0]
    pairs = positive[:, None] - negative[None, :]
    assert row.auc_roc == pytest.approx(np.mean((pairs > 0) + 0.5 * (pairs == 0)))
    levels = sorted(set(score), reverse=True)
    recall = [np.mean(positive >= t) for t in levels]
    precision = [np.mean(truth[score >= t]) for t in levels]
    steps = np.diff([0, *recall])
    assert row.average_precision == pytest.approx(np.sum(steps * precision))
    p = np.clip(score, 1e-7, 1 - 1e-7)
    assert row.loss == pytest.approx(-np.mean(np.where(truth == 1, np.log(p), np.log(1 - p))))


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("digits", [1, 9])
def test_roc_keeps_the_bends_only(spark, bounds, digits):
    truth, score = sample(60, digits)
    df = frame(spark, truth, score)
    levels = sorted(set(score), reverse=True)
    tps = np.array([np.sum((score >= t) & (truth == 1)) for t in levels])
    fps = np.array([np.sum((score >= t) & (truth == 0)) for t in levels])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    expected = [(0.0, 0.0, np.inf)] + [
        (f / fps[-1], t / tps[-1], s) for f, t, s, k in zip(fps, tps, levels, keep) if k
    ]
    got = evaluation.roc_curve(df, bounds=bounds).orderBy(F.col("threshold").desc()).collect()
    assert np.array(got) == pytest.approx(np.array(expected))
    assert evaluation.roc_curve(df, drop_collinear=False, bounds=bounds).count() == len(levels) + 1


@pytest.mark.parametrize("bounds", BOUNDS)
def test_pr_curve(spark, bounds):
    truth, score = sample(80, 1)
    got = evaluation.pr_curve(frame(spark, truth, score), bounds=bounds).collect()
    by_level = {r.threshold: (r.precision, r.recall) for r in got}
    assert by_level.pop(None) == (1.0, 0.0)
    assert by_level == {
        t: pytest.approx((np.mean(truth[score >= t]), np.mean(score[truth == 1] >= t)))
        for t in set(score)
    }


@pytest.mark.parametrize("digits", [2, 9])
def test_threshold_sweep_equals_one_pass_per_threshold(spark, digits):
    truth, score = sample(digits=digits)
    limits = np.arange(0.1, 1.0, 0.02)
    truth = np.r_[truth, np.arange(45) % 2, np.arange(90) % 2]
    score = np.r_[score, limits, np.nextafter(limits, 0), np.nextafter(limits, 1)]
    rows = evaluation.threshold_sweep(frame(spark, truth, score)).collect()
    assert [r.threshold for r in rows] == limits.tolist()
    for r in rows:
        flagged = score >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == (
            np.sum(flagged & (truth == 1)), np.sum(flagged & (truth == 0)),
            np.sum(~flagged & (truth == 1)), np.sum(~flagged & (truth == 0)),
        )
    assert [r.recall for r in rows] == sorted((r.recall for r in rows), reverse=True)
    best = evaluation.best_threshold(evaluation.threshold_sweep(frame(spark, truth, score))).first()
    assert best.threshold == limits[int(np.argmax([r.f1 for r in rows]))]


def test_class_report(spark):
    counts = spark.createDataFrame([(50, 10, 5, 35)], "tn bigint, fp bigint, fn bigint, tp bigint")
    rows = {r["class"]: r for r in evaluation.class_report(counts, ("no", "yes")).collect()}
    assert rows["no"].precision == pytest.approx(50 / 55) and rows["no"].recall == pytest.approx(50 / 60)
    assert rows["yes"].f1 == pytest.approx(70 / 85) and rows["yes"].support == 40
    assert rows["accuracy"].f1 == 0.85
    assert rows["macro avg"].recall == pytest.approx((50 / 60 + 35 / 40) / 2)
    assert rows["weighted avg"].recall == pytest.approx(0.85)


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_histogram_equals_numpy(spark, digits):
    truth, score = sample(digits=digits)
    rows = evaluation.score_histogram(frame(spark, truth, score)).collect()
    for t in (0, 1):
        counts, edges = np.histogram(score[truth == t], bins=60)
        mine = sorted((r for r in rows if r.truth == t), key=lambda r: r.bin)
        assert [r["count"] for r in mine] == counts.tolist()
        assert [r.bin_start for r in mine] + [mine[-1].bin_end] == pytest.approx(edges.tolist())


def test_histogram_of_a_single_score(spark):
    rows = evaluation.score_histogram(frame(spark, [1, 1], [0.4, 0.4])).collect()
    counts, _ = np.histogram([0.4, 0.4], bins=60)
    assert [r["count"] for r in sorted(rows, key=lambda r: r.bin)] == counts.tolist()


@pytest.mark.parametrize("bounds", BOUNDS)
def test_box_stats_equal_numpy(spark, bounds):
    truth, score = sample(301, 3)
    rows = {r.outcome: r for r in evaluation.box_stats(frame(spark, truth, score), bounds=bounds).collect()}
    flagged = score > 0.5
    for name, mask in {"TP": flagged & (truth == 1), "FP": flagged & (truth == 0),
                       "FN": ~flagged & (truth == 1), "TN": ~flagged & (truth == 0)}.items():
        values, r = score[mask], rows[name]
        q1, median, q3 = np.percentile(values, [25, 50, 75])
        reach = 1.5 * (q3 - q1)
        assert r.n == len(values) and r["mean"] == pytest.approx(values.mean())
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, median, q3))
        assert r.whisker_low == min(values[values >= q1 - reach].min(), q1)
        assert r.whisker_high == max(values[values <= q3 + reach].max(), q3)
        notch = 1.57 * (q3 - q1) / np.sqrt(len(values))
        assert (r.notch_low, r.notch_high) == pytest.approx((median - notch, median + notch))


def test_errors(spark):
    truth = [0] * 8 + [1] * 2
    score = [0.9, 0.6, 0.6, 0.7, 0.8, 0.95, 0.55, 0.1, 0.2, 0.9]
    df = frame(spark, truth, score)
    stats = {r.kind: (r.n, r.mean_score) for r in evaluation.error_stats(df).collect()}
    assert stats == {"FP": (7, pytest.approx(np.mean(score[:7]))), "FN": (1, 0.2)}
    examples = evaluation.error_examples(df).collect()
    assert [(r.score, r.url) for r in examples if r.kind == "FP"] == [
        (0.55, "u0006"), (0.6, "u0001"), (0.6, "u0002"), (0.7, "u0003"), (0.8, "u0004"),
    ]


def test_one_class_only(spark):
    row = evaluation.metrics(frame(spark, [0, 0], [0.2, 0.7])).first()
    assert (row.precision, row.recall, row.f1, row.auc_roc) == (0.0, 0.0, 0.0, None)


def test_whole_run(spark, tmp_path):
    (tmp_path / "good").write_text("\n".join(f"http://site{i}.org/a/{i}" for i in range(80)))
    bad = [f"http://evil{i}.biz/login/{i}" for i in range(50)] + ["http://site1.org/a/1"]
    (tmp_path / "bad").write_text("\n".join(bad))
    out = str(tmp_path / "out")
    row = train_and_evaluate(
        spark, {str(tmp_path / "good"): 0, str(tmp_path / "bad"): 1}, out,
        max_rounds=2, max_iter=3, features=1 << 10,
    ).first()
    assert row.tp + row.fn == 10 and row.tn + row.fp == 10
    metrics = spark.read.option("header", True).csv(f"{out}/model_metrics").collect()
    assert [r.Metric for r in metrics] == [name for name, _ in evaluation.METRIC_ROWS]
    assert spark.read.option("header", True).csv(f"{out}/evaluation_summary").first().Count == "20"


@pytest.mark.parametrize("bounds", [[], [0.1, 0.25, 0.5]])
def test_rows_without_a_score_count_alike_everywhere(spark, bounds):
    """They are not flagged, and rank below all others, however the scores are ranked."""
    rows = [(f"u{i}", i % 3 == 0, None if i % 5 == 0 else (i % 7) / 8) for i in range(210)]
    df = spark.createDataFrame([(u, int(t), s) for u, t, s in rows], "url string, truth int, score double")
    counts = evaluation.confusion(df).first()
    found = evaluation.counted(df, bounds)
    measured = evaluation.metrics(found).first()
    assert tuple(counts) == tuple(measured)[:4] and sum(counts) == 210
    ranks = [(-1.0 if s is None else s, t) for _, t, s in rows]
    positives = [s for s, t in ranks if t]
    negatives = [s for s, t in ranks if not t]
    wins = sum((p > n) + (p == n) / 2 for p in positives for n in negatives)
    assert math.isclose(measured.auc_roc, wins / len(positives) / len(negatives))
    for curve in (evaluation.roc_curve(found), evaluation.pr_curve(found)):
        assert curve.filter("threshold = double('-infinity')").count() == 0
    last = evaluation.roc_curve(found, drop_collinear=False).filter("threshold is null").first()
    assert (last.fpr, last.tpr) == (1.0, 1.0)
