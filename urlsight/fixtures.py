"""The pipeline's inputs, derived from the given tables ``events`` and ``pages``.

``classified_urls`` joins every event to a page and scores it with a fixed function of
the event id; the other views are the messages and lists the pipeline would receive. The
same views are spelled in SQL in ``urlsight.oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from urlsight.functions.rows import computed_once
from urlsight.functions.score import label_score
from urlsight.sinks.messages import url_message

TRUE_HOSTS = ("ads-track", "adult-x", "free-bets")


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table. Its schema is inferred, which takes a job, only once per path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def read_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream; the pattern matches a single file and a folder alike."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def _raw_score() -> Column:
    return ((F.col("event_id") * 7919) % 10007).cast("double") / 10007


def _truth(url: Column) -> Column:
    malicious = F.lit(False)
    for host in TRUE_HOSTS:
        malicious = malicious | url.contains(host)
    return malicious.cast("int")


def on_pages(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Events with the URL of their page. Works on a stream of events as well.

    The number of pages comes from file footers. Ids are spread evenly over the pages, so
    no page is a hot key; whether the pages are broadcast is left to their size.
    """
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("_page"), "url")
    paged = events.withColumn("_page", F.col("event_id") % F.lit(pages.count()))
    return paged.join(pages, "_page").drop("_page")


def classify_events(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    joined = on_pages(spark, sf_dir, events)
    raw = _raw_score()
    return joined.select(
        "event_id", "url", "event_type",
        label_score(raw).alias("classification"),
        F.round(raw, 2).alias("score"),
        raw.alias("raw"),
        F.col("ts").cast("timestamp").alias("time_added"),
        _truth(F.col("url")).alias("truth"),
    )


def classified_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_events(spark, sf_dir, read(spark, sf_dir, "events"))


def latest(spark: SparkSession, sf_dir: str) -> Column:
    """The newest event time, the "now" of the test queries."""
    return read(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``(url, truth, score)`` for the evaluation, with the unrounded score."""
    return classified_urls(spark, sf_dir).select("url", "truth", F.col("raw").alias("score"))


def hot_scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``scored_rows``, but 95 of 100 scores are alike, one is NULL and one is NaN."""
    turn = F.col("event_id") % 100
    score = F.when(turn >= 5, F.lit(0.25)).when(turn >= 2, F.col("raw")).when(turn == 1, F.lit(float("nan")))
    return classified_urls(spark, sf_dir).select("url", "truth", score.alias("score"))


def url_corpus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs with repeats and conflicting labels; each URL occurs about four times."""
    pages = read(spark, sf_dir, "pages").count()
    variant = F.floor(F.col("event_id") / F.lit(4 * pages)).cast("string")
    noisy = (F.col("event_type") == "error") & (F.col("event_id") % 10 < 5)
    return classified_urls(spark, sf_dir).select(
        F.concat("url", F.lit("/v"), variant).alias("url"),
        F.when(noisy | (F.col("truth") == 1), 1).otherwise(0).alias("label"),
    )


def messy_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in upper case, with ``www.``, without scheme, with inner schemes, very long."""
    url, turn = F.col("url"), F.col("event_id") % 6
    messy = (
        F.when(turn == 0, url)
        .when(turn == 1, F.upper(url))
        .when(turn == 2, F.replace(url, F.lit("://"), F.lit("://www.")))
        .when(turn == 3, F.regexp_replace(url, "^https?://", ""))
        .when(turn == 4, F.concat(url, F.lit("?next="), url))
        .otherwise(F.repeat(url, F.lit(16)))
    )
    return classified_urls(spark, sf_dir).select("event_id", messy.alias("url"))


def _host(url: Column) -> Column:
    return F.regexp_extract(url, "https?://([^/]+)", 1)


def ct_messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Certificate stream messages; errors are heartbeats and some are no JSON at all."""
    events = read(spark, sf_dir, "events") if events is None else events
    host = _host(F.col("url"))
    kind = F.when(F.col("event_type") == "error", "heartbeat").otherwise("certificate_update")
    body = F.concat(
        F.lit('{"message_type":"'), kind, F.lit('","data":{"leaf_cert":{"all_domains":["'),
        host, F.lit('","*.'), host, F.lit('","v'), (F.col("event_id") % 7).cast("string"),
        F.lit("."), host, F.lit('"]}}}'),
    )
    value = F.when(F.col("event_id") % 50 == 49, F.lit("test message")).otherwise(body)
    sent = computed_once(on_pages(spark, sf_dir, events), "value", value)
    return sent.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")


def ct_records(
    spark: SparkSession, sf_dir: str, events: DataFrame | None = None
) -> DataFrame:
    """Search records with blanks, wildcards, missing names and certificate metadata.

    One record per event; the id repeats, as when a search is polled again.
    """
    events = read(spark, sf_dir, "events") if events is None else events
    host = _host(F.col("url"))
    turn = F.col("event_id")
    names = F.concat(host, F.lit("\n*."), host, F.lit("\n "), host, F.lit("\n"))
    common = (
        F.when(turn % 3 == 0, host)
        .when(turn % 3 == 1, F.concat(F.lit("Visit "), host))
        .when(turn % 11 == 5, F.concat(F.lit("cn."), host, F.lit(".ru")))
        .otherwise(F.concat(F.lit("cn"), (turn % 11).cast("string"), F.lit("."), host))
    )
    return on_pages(spark, sf_dir, events).select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.floor(turn / 2).cast("bigint") + 1).alias("id"),
        F.when(turn % 7 != 0, names).alias("name_value"),
        common.alias("common_name"),
    )


def ct_search_bodies(
    spark: SparkSession, sf_dir: str, events: DataFrame | None = None
) -> DataFrame:
    """One search response per record; every fiftieth is an error page."""
    record = F.to_json(F.array(F.struct("id", "name_value", "common_name")))
    body = F.when(F.col("id") % 50 == 0, F.lit("<html>busy</html>")).otherwise(record)
    return computed_once(ct_records(spark, sf_dir, events), "value", body).select("ts", "value")


def envelopes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Base64 URL batches; errors are not JSON, and some batches have no list."""
    events = read(spark, sf_dir, "events") if events is None else events
    urls = F.array("url", F.concat(F.lit("*."), _host(F.col("url"))))
    text = (
        F.when(F.col("event_type") == "error", F.lit("test message"))
        .when(F.col("event_id") % 10 == 7, F.lit("{}"))
        .otherwise(url_message(urls))
    )
    data = F.base64(F.encode(text, "UTF-8"))
    return computed_once(on_pages(spark, sf_dir, events), "data", data).select("event_id", "data")


def submissions(
    spark: SparkSession, sf_dir: str, events: DataFrame | None = None
) -> DataFrame:
    """Requests of two rows each; errors carry an unreadable score, some an unknown field."""
    events = read(spark, sf_dir, "events") if events is None else events
    stamp = F.date_format("time_added", "yyyy-MM-dd HH:mm:ss.SSSSSS")

    def row(score: Column, extra: Column) -> Column:
        return F.concat(
            F.lit('{"url":"'), F.col("url"), F.lit('","score":'), score,
            F.lit(',"classification":"'), F.col("classification"),
            F.lit('","time_added":"'), stamp, F.lit('"'), extra, F.lit("}"),
        )

    score = F.col("score").cast("string")
    second = F.when(F.col("event_type") == "error", F.lit('"high"')).otherwise(score)
    extra = F.when(F.col("event_id") % 20 == 3, F.lit(',"note":"x"')).otherwise(F.lit(""))
    body = F.concat(F.lit("["), row(score, F.lit("")), F.lit(","), row(second, extra), F.lit("]"))
    sent = computed_once(classify_events(spark, sf_dir, events), "value", body)
    return sent.select("event_id", "value")
