"""Parsers for the JSON messages of the pipeline, for batch and streaming frames alike.

Each parser adds the parsed columns and ``error``, which is NULL on a good row.
``good_rows`` and ``dead_letters`` part the two, so nothing malformed ends a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.functions.predicates import has_monitored_tld
from urlsight.functions.rows import computed_once, unnest
from urlsight.schemas import CERT_MESSAGE, CERT_RECORDS, CORRUPT, URL_BATCH

CERT_UPDATE = "certificate_update"


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull())


def parse_ct_messages(df: DataFrame, body: str = "value") -> DataFrame:
    """Stream messages of type ``certificate_update`` as ``all_domains``.

    Other message types are left out; what is not JSON, or lacks the domain list, stays
    with its ``error``.
    """
    message = F.from_json(F.col(body), CERT_MESSAGE, {"columnNameOfCorruptRecord": CORRUPT})
    domains = F.col("_message.data.leaf_cert.all_domains")
    malformed = F.col("_message").isNull() | F.col(f"_message.{CORRUPT}").isNotNull()
    update = F.col("_message.message_type") == CERT_UPDATE
    error = (
        F.when(malformed, F.lit("not a JSON object"))
        .when(update & domains.isNull(), F.lit("no domain list"))
    )
    return (
        computed_once(df, "_message", message)
        .withColumn("all_domains", domains)
        .withColumn("error", error)
        .filter(F.col("error").isNotNull() | update)
        .drop("_message")
    )


def parse_ct_search(df: DataFrame, body: str = "value") -> DataFrame:
    """Search responses as ``records``, an array of certificate records.

    A body that is not a JSON array keeps its ``error``.
    """
    is_array = F.coalesce(F.ltrim(F.col(body)).startswith("["), F.lit(False))
    records = F.when(is_array, F.from_json(F.col(body), CERT_RECORDS))
    return computed_once(df, "records", records).withColumn(
        "error", F.when(F.col("records").isNull(), F.lit("not a JSON array of objects"))
    )


def search_records(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row ``(id, name_value, common_name)`` per certificate record, and ``keep``."""
    records = unnest(good_rows(parsed).select(*keep, "records"), "records", "record")
    return records.filter(F.col("record").isNotNull()).select(*keep, "record.*")


def newer_than(records: DataFrame, mark: int | Column | None) -> DataFrame:
    """Records above the resume mark; no mark, or the mark 0, means all of them."""
    if mark is None or (isinstance(mark, int) and mark == 0):
        return records
    return records.filter(F.col("id") > mark)


def with_monitored_tld(df: DataFrame, name: str = "domain") -> DataFrame:
    """Rows whose name ends in a watched top-level domain, all of them in one pass."""
    return df.filter(has_monitored_tld(F.col(name)))


def decode_envelopes(df: DataFrame, data: str = "data") -> DataFrame:
    """Event envelopes (base64 of a JSON URL batch) as ``urls``; a missing list is empty."""
    # Characters outside the alphabet are skipped, as lenient base64 decoders do.
    cleaned = F.regexp_replace(F.col(data), "[^A-Za-z0-9+/=]", "")
    text = F.try_validate_utf8(F.try_to_binary(cleaned, F.lit("base64")).cast("string"))
    batch = F.from_json(text, URL_BATCH, {"columnNameOfCorruptRecord": CORRUPT})
    urls = F.coalesce(F.col("_batch.urls"), F.array().cast("array<string>"))
    error = (
        F.when(F.col("_batch").isNull(), F.lit("not base64 of UTF-8 text"))
        .when(F.col(f"_batch.{CORRUPT}").isNotNull(), F.lit("not a JSON object"))
        .when(F.exists(urls, lambda u: u.isNull()), F.lit("empty entry in the URL list"))
    )
    return (
        computed_once(df, "_batch", batch)
        .withColumn("urls", urls)
        .withColumn("error", error)
        .drop("_batch")
    )
