"""Outgoing URL batches and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.functions.text import iso_columns


def url_message(urls: Column) -> Column:
    """JSON text ``{"urls": [...]}`` of an array of URLs."""
    return F.to_json(F.struct(urls.alias("urls")))


def url_messages(df: DataFrame, urls: str = "urls") -> DataFrame:
    """One message per row with a non-empty list, as the ``value`` a text or Kafka sink takes."""
    return df.filter(F.size(urls) > 0).select(url_message(F.col(urls)).alias("value"))


def alert_messages(df: DataFrame) -> DataFrame:
    """One JSON message per row, all columns, for the feed of live subscribers."""
    shown = iso_columns(df)
    return shown.select(F.to_json(F.struct(*shown.columns)).alias("value"))


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.select("value").write.mode(mode).text(path)


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish messages; needs the public Kafka connector on the session's class path."""
    (
        messages.select("value").write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
