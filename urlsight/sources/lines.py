"""Labelled URL lists: one URL per line, one label per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.functions.text import drop_invalid_utf8, strip


def read_labelled_lines(spark: SparkSession, labels: dict[str, int]) -> DataFrame:
    """Rows ``(url, label)`` of the given ``{path: label}`` files, blank lines dropped."""
    frames = [
        spark.read.text(path).select(
            strip(drop_invalid_utf8(F.col("value"))).alias("url"),
            F.lit(label).alias("label"),
        )
        for path, label in labels.items()
    ]
    return reduce(DataFrame.unionByName, frames).filter(F.col("url") != "")
