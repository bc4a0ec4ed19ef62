"""Score, label and band expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MALICIOUS = "MALICIOUS"
BENIGN = "BENIGN"
THRESHOLD = 0.5

# Lower bounds (inclusive) of the confidence bands, highest first.
SCORE_BANDS = (
    (0.9, "0.9-1.0"), (0.7, "0.7-0.9"), (0.5, "0.5-0.7"), (0.3, "0.3-0.5"), (0.1, "0.1-0.3"),
)
LOWEST_SCORE_BAND = "0.0-0.1"

# Upper bounds (exclusive) of the URL length bands, lowest first.
LENGTH_BANDS = ((30, "0-30"), (50, "30-50"), (75, "50-75"), (100, "75-100"))
HIGHEST_LENGTH_BAND = "100+"


def label_score(score: Column, threshold: float = THRESHOLD) -> Column:
    """Class of a raw score. Call it before rounding: 0.503 is malicious, its 0.5 is not."""
    return F.when(score > F.lit(threshold), F.lit(MALICIOUS)).otherwise(F.lit(BENIGN))


def round_score(score: Column) -> Column:
    """Two decimals, half to even, of the score as the model's 32-bit float."""
    return F.bround(score.cast("float").cast("double"), 2)


def is_malicious(classification: Column) -> Column:
    """1 for the malicious class, 0 for anything else, NULL included."""
    return F.when(classification == MALICIOUS, F.lit(1)).otherwise(F.lit(0))


def score_band(score: Column) -> Column:
    """Confidence band; NULL falls into the lowest."""
    (bound, name), *rest = SCORE_BANDS
    band = F.when(score >= F.lit(bound), F.lit(name))
    for bound, name in rest:
        band = band.when(score >= F.lit(bound), F.lit(name))
    return band.otherwise(F.lit(LOWEST_SCORE_BAND))


def length_band(url: Column) -> Column:
    """Band of the URL's length in characters; NULL falls into the highest."""
    length = F.length(url)
    (bound, name), *rest = LENGTH_BANDS
    band = F.when(length < F.lit(bound), F.lit(name))
    for bound, name in rest:
        band = band.when(length < F.lit(bound), F.lit(name))
    return band.otherwise(F.lit(HIGHEST_LENGTH_BAND))
