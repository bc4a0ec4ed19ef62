"""The monitoring questions over the table of classified URLs.

Every query is one scan with partial aggregation or a top-k; ``as_of`` stands for "now".
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.functions.score import BENIGN, MALICIOUS, is_malicious, length_band, score_band
from urlsight.functions.text import extract_domain, has_domain
from urlsight.sources.table import since

AsOf = datetime | Column | None


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * F.lit(100.0), 2), F.lit(0.0))


def stats(df: DataFrame) -> DataFrame:
    """One row of totals, rates and confidence figures; zeros on an empty table.

    ``false_positive_rate`` is the share of benign rows scored above 0.3 in all rows. It
    keeps its name from the dashboard; the rate against known truth is in ``evaluation``.
    """
    malicious = F.col("classification") == MALICIOUS
    benign = F.col("classification") == BENIGN
    score = F.col("score")
    totals = df.agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(malicious).alias("total_malicious"),
        F.avg(F.when(malicious, score)).alias("avg_malicious"),
        F.avg(F.when(benign, score)).alias("avg_benign"),
        F.count_if(malicious & (score < 0.7)).alias("low_confidence_malicious"),
        F.count_if(benign & (score > 0.3)).alias("low_confidence_benign"),
    )
    total, bad = F.col("total_urls"), F.col("total_malicious")
    return totals.select(
        total,
        bad,
        (total - bad).alias("total_benign"),
        _percent(bad, total).alias("malicious_rate"),
        _percent(total - bad, total).alias("benign_rate"),
        F.round(F.coalesce("avg_malicious", F.lit(0.0)), 3).alias("avg_malicious_confidence"),
        F.round(F.coalesce("avg_benign", F.lit(0.0)), 3).alias("avg_benign_confidence"),
        "low_confidence_malicious",
        "low_confidence_benign",
        _percent(F.col("low_confidence_benign"), total).alias("false_positive_rate"),
    )


def realtime(df: DataFrame, as_of: AsOf = None, interval: str = "1 HOUR") -> DataFrame:
    """Totals of the last hour and the time of the latest row."""
    return since(df, as_of, interval).agg(
        F.count(F.lit(1)).alias("total_last_hour"),
        F.count_if(F.col("classification") == MALICIOUS).alias("malicious_last_hour"),
        F.max("time_added").alias("latest_detection"),
    )


def confidence(df: DataFrame) -> DataFrame:
    """Rows per class and confidence band."""
    counted = df.groupBy("classification", score_band(F.col("score")).alias("confidence_range")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.orderBy("classification", F.col("confidence_range").desc()).select(
        is_malicious(F.col("classification")).alias("classification"), "confidence_range", "count"
    )


def timeline(df: DataFrame, as_of: AsOf = None, interval: str = "30 MINUTES") -> DataFrame:
    """Rows per minute and class over the last half hour."""
    counted = (
        since(df, as_of, interval)
        .groupBy(F.date_trunc("minute", "time_added").alias("time_bucket"), "classification")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.orderBy("time_bucket", "classification").select(
        "time_bucket", is_malicious(F.col("classification")).alias("classification"), "count"
    )


def detection_rate(df: DataFrame, as_of: AsOf = None, interval: str = "7 DAYS") -> DataFrame:
    """Share of malicious rows per day over the last 168 hours."""
    malicious = F.count_if(F.col("classification") == MALICIOUS)
    return (
        since(df, as_of, interval)
        .groupBy(F.to_date("time_added").alias("date"))
        .agg(
            F.round(malicious * F.lit(100.0) / F.count(F.lit(1)), 2).alias("detection_rate"),
            F.count(F.lit(1)).alias("total_urls"),
        )
        .orderBy("date")
    )


def top_domains(df: DataFrame, k: int = 15) -> DataFrame:
    """The domains with the most malicious rows."""
    return (
        df.filter((F.col("classification") == MALICIOUS) & has_domain(F.col("url")))
        .select(extract_domain(F.col("url")).alias("domain"), "score")
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("avg_confidence"))
        .orderBy(F.col("count").desc(), "domain")
        .limit(k)
    )


def url_length(df: DataFrame) -> DataFrame:
    """Rows per length band and class, bands in text order."""
    counted = df.groupBy(length_band(F.col("url")).alias("length_range"), "classification").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.orderBy("length_range", "classification").select(
        "length_range", is_malicious(F.col("classification")).alias("is_phishing"), "count"
    )


def recent(df: DataFrame, k: int = 100) -> DataFrame:
    """The newest rows, oldest of them first."""
    newest_first = [F.col(c).desc() for c in ("time_added", "url", "score", "classification")]
    oldest_first = [F.col(c).asc() for c in ("timestamp", "url", "score", "classification")]
    return (
        df.select("time_added", "url", "classification", "score")
        .orderBy(*newest_first)
        .limit(k)
        .select(
            F.col("time_added").alias("timestamp"), "url", "classification",
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
        .orderBy(*oldest_first)
    )


def top_malicious(df: DataFrame, k: int = 20) -> DataFrame:
    """The malicious rows with the highest scores, newest first among equals."""
    return (
        df.filter(F.col("classification") == MALICIOUS)
        .select("url", "score", "time_added")
        .orderBy(F.col("score").desc(), F.col("time_added").desc(), "url")
        .limit(k)
        .select("url", F.col("score").alias("confidence"), F.col("time_added").alias("timestamp"))
    )
