"""Every operator as a query over the given tables, by name."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from urlsight import fixtures as fx
from urlsight.functions import predicates, score, text
from urlsight.operators import batching, corpus, epochs, features, ingest, model, recent, scoring
from urlsight.operators.ranking import numbered
from urlsight.plans import dashboard, evaluation
from urlsight.session import shared_dir, stored
from urlsight.sinks import feed, layout, reports, submissions
from urlsight.sinks import messages as out
from urlsight.sinks import table as sink
from urlsight.sinks.batches import keyed_writer, read_batches
from urlsight.sources import lines, messages, records, table
from urlsight.streaming import jobs

#: Bytes of a publisher's batch, few enough for the given messages to meet both bounds.
MESSAGE_BYTES = 1450

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Replays run over a month of events; with this delay no row comes too late.
REPLAY_DELAY = "365 days"
FILES = 4


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(names: Column | str, by: str = "|") -> Column:
    return F.array_join(names, by)


# ------------------------------------------------------------------ sources


@query
def src_labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.url_corpus_raw(spark, sf_dir)
    noisy = F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" \t")), F.lit("   ")))
    paths = {}
    for label in (0, 1):
        path = shared_dir(spark, f"lines-{label}")
        rows.filter(F.col("label") == label).select(noisy.alias("value")).write.text(path)
        paths[path] = label
    return lines.read_labelled_lines(spark, paths)


@query
def src_ct_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = messages.parse_ct_messages(fx.ct_messages(spark, sf_dir))
    return messages.good_rows(parsed).select("event_id", _joined("all_domains").alias("domains"))


@query
def src_ct_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.search_records(messages.parse_ct_search(fx.ct_search_bodies(spark, sf_dir)))


@query
def src_ct_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fx.ct_records(spark, sf_dir)
    half = records.agg(F.max("id") / 2).scalar()
    path = shared_dir(spark, "mark")
    ingest.save_mark(ingest.highest_id(records.filter(F.col("id") <= half)), path)
    return messages.newer_than(records, ingest.load_mark(spark, path)).select("id", "common_name")


@query
def src_ct_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by a source whose offset is the highest id: stopped after half of the ids, then resumed."""
    service, path, checkpoint = (shared_dir(spark, n) for n in ("service", "records", "checkpoint"))
    held = stored(fx.ct_records(spark, sf_dir).select("id", "name_value", "common_name"), "held")
    half = held.agg(F.max("id") / 2).scalar()

    def write(batch: DataFrame, folder: str) -> None:
        batch.write.mode("overwrite").parquet(folder)

    for part in (F.col("id") <= half, F.col("id") > half):
        # By id, so that the statistics of a file tell which tasks need it.
        rows = held.filter(part).repartitionByRange("id").sortWithinPartitions("id")
        rows.write.mode("append").parquet(service)
        jobs.drain(keyed_writer(records.record_stream(spark, service), path, checkpoint, write))
    return read_batches(spark, path, "id bigint, common_name string").drop("run", "batch")


@query
def src_tld_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.with_monitored_tld(_names(spark, sf_dir)).select("id", "domain")


@query
def src_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = messages.good_rows(messages.decode_envelopes(fx.envelopes(spark, sf_dir)))
    return decoded.filter(F.size("urls") > 0).select("event_id", _joined("urls").alias("urls"))


@query
def src_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = {
        "envelope": messages.decode_envelopes(fx.envelopes(spark, sf_dir)),
        "stream": messages.parse_ct_messages(fx.ct_messages(spark, sf_dir)),
    }
    dead = [
        messages.dead_letters(df).select(F.lit(name).alias("source"), "event_id", "error")
        for name, df in parsed.items()
    ]
    return dead[0].unionByName(dead[1])


@query
def src_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "classified")
    sink.write_classified(fx.classified_urls(spark, sf_dir), path)
    recent = table.since(table.read_classified(spark, path), fx.latest(spark, sf_dir), "7 DAYS")
    return text.iso_columns(recent.select("url", "score", "classification", "time_added"))


# ------------------------------------------------------------------ sinks


@query
def sink_url_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "batches")
    out.write_messages(out.url_messages(_batches(spark, sf_dir)), path)
    return spark.read.text(path)


@query
def sink_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "classified")
    rows = fx.classified_urls(spark, sf_dir)
    for label in (score.MALICIOUS, score.BENIGN):
        sink.write_classified(rows.filter(F.col("classification") == label), path)
    return text.iso_columns(table.read_classified(spark, path).select(*sink.COLUMNS))


@query
def sink_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "classified")
    sink.write_classified(fx.classified_urls(spark, sf_dir), path)
    counted = (
        table.read_classified(spark, path).groupBy("dt", "classification")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total_score"))
    )
    return text.iso_columns(counted)


@query
def sink_layout_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that a stream wrote in many batches, its closed days laid out: rows by day, and whether
    a closed day is read from few files."""
    path, checkpoint = shared_dir(spark, "classified"), shared_dir(spark, "checkpoint")
    rows = fx.classified_urls(spark, sf_dir).select(*sink.COLUMNS)
    schema, source = rows.schema, shared_dir(spark, "files")
    for part in range(FILES):
        rows.filter(F.pmod(F.hash("time_added"), F.lit(FILES)) == part).repartition(2).write.mode("append").parquet(source)

        def write(batch: DataFrame, folder: str) -> None:
            sink.write_batch(sink.with_day(batch), folder)

        jobs.drain(keyed_writer(jobs.file_stream(spark, source, schema), path, checkpoint, write))
    last = rows.agg(F.max(F.to_date("time_added")).cast("string")).first()[0]
    if last:
        layout.lay_out_closed_days(spark, path, last)
    closed = F.col("dt") < F.lit(last).cast("date")
    counted = table.read_classified(spark, path).groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total_score"),
        F.count_distinct("_metadata.file_path").alias("files"),
    )
    # The newest batch of the stream waits for the next job.
    few = (~closed | (F.col("files") <= 4)).alias("few_files")
    return text.iso_columns(counted.select("dt", "n", "total_score", few))


@query
def sink_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "submitted")
    submissions.submit(fx.submissions(spark, sf_dir), path)
    return text.iso_columns(table.read_classified(spark, path).select(*sink.COLUMNS))


@query
def sink_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "metrics")
    measured = evaluation.metrics(fx.scored_rows(spark, sf_dir))
    reports.write_csv_report(evaluation.metrics_table(measured), path)
    return spark.read.schema("Metric string, Value string").option("header", True).csv(path)


@query
def sink_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "alerts")
    requests = fx.submissions(spark, sf_dir, fx.read_events_stream(spark, sf_dir))
    rows = submissions.accepted_rows(submissions.parse_submissions(requests))
    jobs.drain(jobs.alert_stream(rows.select(*sink.COLUMNS), path, shared_dir(spark, "checkpoint")))
    shape = "url string, score double, classification string, time_added string"
    return read_batches(spark, path, shape, "json").drop("run", "batch")


@query
def sink_alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of ``sink_alerts`` through a feed that publishes each batch whole, several batches."""
    path, checkpoint, source = (shared_dir(spark, n) for n in ("feed", "checkpoint", "files"))
    schema = fx.read(spark, sf_dir, "events").schema
    for turn in range(2):
        fx.read(spark, sf_dir, "events").filter(F.col("event_id") % 2 == turn).write.mode("append").parquet(source)
        requests = fx.submissions(spark, sf_dir, jobs.file_stream(spark, source, schema))
        rows = submissions.accepted_rows(submissions.parse_submissions(requests))
        jobs.drain(feed.feed_stream(rows.select(*sink.COLUMNS), path, checkpoint))
    return feed.read_feed(spark, path, "url string, score double, classification string, time_added string")


@query
def sink_all_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table that a stream, a batch job and submissions add to."""
    path = shared_dir(spark, "classified")

    def by_length(url: Column) -> Column:
        return (F.length(url) % 100) / 100

    stream = fx.envelopes(spark, sf_dir, fx.read_events_stream(spark, sf_dir))
    writer = jobs.score_stream(stream, by_length, path, shared_dir(spark, "checkpoint"))
    jobs.drain(writer)
    sink.write_classified(fx.classified_urls(spark, sf_dir), path)
    submissions.submit(fx.submissions(spark, sf_dir), path)
    return table.read_classified(spark, path).select("url", "score", "classification")




@query
def sink_message_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publisher batches of all certificate messages, in the order of their events."""
    sent = numbered(fx.ct_messages(spark, sf_dir).select("event_id", "value"), ["event_id"])
    packed = batching.message_batches(sent, most_bytes=MESSAGE_BYTES)
    return packed.withColumn("messages", F.md5(_joined("messages", "\n")))


# ------------------------------------------------------------------ expressions


@query
def fn_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalized = text.normalize_url(F.col("url")).alias("normalized")
    return fx.messy_urls(spark, sf_dir).select("event_id", normalized)


@query
def fn_char_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = text.spaced_characters(text.normalize_url(F.col("url"))).alias("characters")
    return fx.messy_urls(spark, sf_dir).select("event_id", spaced)


@query
def fn_extract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = text.certificate_names(F.col("name_value"), F.col("common_name"))
    return fx.ct_records(spark, sf_dir).select("id", _joined(names).alias("names"))


@query
def fn_url_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.messy_urls(spark, sf_dir).select("event_id", F.length("url").alias("length"))


@query
def fn_extract_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = text.extract_domain(F.col("url")).alias("domain")
    return fx.messy_urls(spark, sf_dir).select("event_id", domain)


@query
def fn_round_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = score.round_score(F.col("raw")).alias("score")
    return fx.classified_urls(spark, sf_dir).select("event_id", rounded)


@query
def fn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = score.label_score(F.col("raw")).alias("classification")
    return fx.classified_urls(spark, sf_dir).select("event_id", label)


@query
def fn_label_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = score.is_malicious(F.col("classification")).alias("malicious")
    return fx.classified_urls(spark, sf_dir).select("event_id", flag)


@query
def fn_prefix80(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return fx.messy_urls(spark, sf_dir).select(
        "event_id",
        text.url_prefix(url).alias("url"),
        text.domain_prefix(text.extract_domain(url)).alias("domain"),
    )


# ------------------------------------------------------------------ ingest


def _certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = text.certificate_names(F.col("name_value"), F.col("common_name"))
    key = ingest.record_key("id", "name_value", "common_name")
    return fx.ct_records(spark, sf_dir).select("id", key.alias("record"), names.alias("names"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.explode_domains(_certificates(spark, sf_dir), "names")


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).filter(predicates.is_valid_domain(F.col("domain")))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_seen(_valid(spark, sf_dir), "domain", ["id", "record", "pos"])


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.regroup(_fresh(spark, sf_dir), ["id", "record"])


@query
def flt_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.drop_wildcards(_names(spark, sf_dir), "domain").select("id", "pos", "domain")


@query
def flt_valid_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select("id", "pos", "domain")


@query
def flt_valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = predicates.valid_names(F.col("names"))
    return _certificates(spark, sf_dir).select("id", _joined(kept).alias("names"))


@query
def dedup_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).select("domain", "id", "pos")


#: Names that are remembered, few enough for names to be forgotten in the given tables.
RECENT = 700


@query
def dedup_recent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were not published within the last ``RECENT`` names."""
    named = _valid(spark, sf_dir).select("id", "record", "pos", "domain")
    rows = numbered(named, ["id", "record", "pos"])
    return recent.published(rows, RECENT)


@query
def explode_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = messages.good_rows(messages.parse_ct_messages(fx.ct_messages(spark, sf_dir)))
    listed = parsed.select("event_id", "all_domains")
    return ingest.explode_domains(listed, "all_domains")


@query
def regroup_by_cert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("id", _joined("urls").alias("urls"))


@query
def max_id_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.highest_id(fx.ct_records(spark, sf_dir))


def _parts_in_time(spark: SparkSession, label: str, rows: DataFrame, parts: int = FILES) -> Iterator[str]:
    """``rows(ts, value)`` added to a folder part by part in the order of time; the folder, after each part.

    Rows without a time come first. Each part is written by as many tasks as it needs, and a job
    that drains the folder after each of them has the part as one batch.
    """
    path, staged = shared_dir(spark, label), shared_dir(spark, f"{label}-parts")
    ends = rows.agg(F.percentile_approx("ts", [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    part = F.lit(0)
    for end in ends:
        part = part + F.coalesce((F.col("ts") > F.lit(end)).cast("int"), F.lit(0))
    rows.withColumn("part", part).write.partitionBy("part").parquet(staged)
    cut = spark.read.schema("ts timestamp, value string, part int").parquet(staged)
    for k in range(parts):
        cut.filter(F.col("part") == k).select("ts", "value").write.mode("append").parquet(path)
        yield path


def _timed_stream(spark: SparkSession, path: str) -> DataFrame:
    return jobs.file_stream(spark, path, StructType.fromDDL("ts timestamp, value string"))


@query
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime counters over many batches, restarts and two checkpoints."""
    path = shared_dir(spark, "batches")
    sent = fx.ct_messages(spark, sf_dir)
    for turn in (0, 1):
        half = sent.filter(F.col("event_id") % 2 == turn).select("ts", "value")
        checkpoint = shared_dir(spark, "checkpoint")
        for source in _parts_in_time(spark, "messages", half, 3):
            lists = jobs.names_of_messages(_timed_stream(spark, source))
            jobs.drain(jobs.certificate_stream(lists, path, checkpoint))
    return ingest.published_so_far(spark, jobs.counters_of(path))


# ------------------------------------------------------------------ dashboard


@query
def dash_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.stats(fx.classified_urls(spark, sf_dir))


@query
def dash_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = fx.latest(spark, sf_dir)
    return text.iso_columns(dashboard.realtime(fx.classified_urls(spark, sf_dir), now))


@query
def dash_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.confidence(fx.classified_urls(spark, sf_dir))


@query
def dash_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = fx.latest(spark, sf_dir)
    return text.iso_columns(dashboard.timeline(fx.classified_urls(spark, sf_dir), now))


@query
def dash_detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = fx.latest(spark, sf_dir)
    return text.iso_columns(dashboard.detection_rate(fx.classified_urls(spark, sf_dir), now))


@query
def dash_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dashboard.top_domains(fx.classified_urls(spark, sf_dir))
    return top.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def dash_url_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.url_length(fx.classified_urls(spark, sf_dir))


@query
def dash_recent_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.iso_columns(dashboard.recent(fx.classified_urls(spark, sf_dir)))


@query
def dash_top_malicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.iso_columns(dashboard.top_malicious(fx.classified_urls(spark, sf_dir)))


# ------------------------------------------------------------------ corpus


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedup_corpus(fx.url_corpus_raw(spark, sf_dir))


def _stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus de-duplicated once: each pass over it is then a plain scan."""
    return stored(_corpus(spark, sf_dir), "corpus")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.balance_split(_stored_corpus(spark, sf_dir))


def _only(split: DataFrame, part: str) -> DataFrame:
    return split.filter(F.col("part") == part).drop("part")


@query
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.url_corpus_raw(spark, sf_dir)
    return corpus.union_corpus(rows.filter("label = 0"), rows.filter("label = 1"))


@query
def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir)


@query
def corpus_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedup_report(fx.url_corpus_raw(spark, sf_dir))


@query
def corpus_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.class_counts(_corpus(spark, sf_dir))


@query
def corpus_balance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


@query
def corpus_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shuffle_corpus(_stored_corpus(spark, sf_dir), seed=7)


@query
def corpus_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stratified_split(_stored_corpus(spark, sf_dir))


@query
def corpus_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = corpus.class_weights(_corpus(spark, sf_dir))
    return weights.withColumn("weight", F.round("weight", 6))


# ------------------------------------------------------------------ features and models


@query
def feat_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.char_vocab(_corpus(spark, sf_dir))


@query
def feat_vectorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    vectors = features.vectorize(rows, features.char_vocab(rows))
    return vectors.select("url", _joined("ids", ",").alias("ids"))


@query
def feat_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.gram_counts(_corpus(spark, sf_dir))


@query
def model_nb_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = model.train_table(_only(_split(spark, sf_dir), corpus.TRAIN))
    return learned.withColumn("log_odds", F.round("log_odds", 6))


def _saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "model")
    model.save_table(model.train_table(_only(_split(spark, sf_dir), corpus.TRAIN)), path)
    return model.load_table(spark, path)


@query
def model_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved_table(spark, sf_dir).withColumn("log_odds", F.round("log_odds", 6))


# Floors that the models must reach on held-out rows of the given tables.
LEAST_ACCURACY = 0.6


@query
def model_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out rows, and whether each has a probability that saving does not change."""
    split = _split(spark, sf_dir)
    fitted = model.train(_only(split, corpus.TRAIN))
    path = shared_dir(spark, "pipeline")
    model.save_model(fitted, path)
    test = _only(split, corpus.TEST)
    first = model.predict(test, fitted).withColumnRenamed("raw", "first")
    both = model.predict(first, model.load_model(path))
    return both.select(
        "url", "label",
        F.coalesce(F.col("raw").between(0, 1), F.lit(False)).alias("is_probability"),
        (F.abs(F.col("raw") - F.col("first")) < 1e-9).alias("survives_saving"),
    )


@query
def model_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a search: sizes of its parts, that its best round is the best, and its accuracy."""
    parts = corpus.stratified_split(stored(_only(_split(spark, sf_dir), corpus.TRAIN), "train"))
    training, validation = _only(parts, corpus.TRAIN), _only(parts, corpus.VALIDATION)
    chosen = model.select_model(training, validation, max_rounds=3, max_iter=5)
    loss, accuracy = model.validation_scores(model.predict(validation, chosen.by_loss))
    sizes = parts.agg(
        F.count_if(F.col("part") == corpus.TRAIN).alias("n_train"),
        F.count_if(F.col("part") == corpus.VALIDATION).alias("n_validation"),
    )
    return sizes.select(
        "*",
        F.lit(1 <= len(chosen.history) <= 3).alias("rounds_in_bounds"),
        F.lit(abs(min(h[2] for h in chosen.history) - loss) < 1e-9).alias("best_has_least_loss"),
        F.lit(accuracy >= LEAST_ACCURACY).alias("accurate"),
    )


@query
def model_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a training in epochs: sizes, that the best epoch is the best, and a loss not above that of
    ``model.train`` on the same rows."""
    parts = corpus.stratified_split(stored(_only(_split(spark, sf_dir), corpus.TRAIN), "train"))
    training, validation = (stored(_only(parts, name), name) for name in (corpus.TRAIN, corpus.VALIDATION))
    chosen = epochs.train_in_epochs(training, validation)
    path = shared_dir(spark, "weights")
    epochs.save_weights(spark, chosen, path)
    loss, accuracy = epochs.held_out_scores(epochs.predict(validation, epochs.load_weights(spark, path)))
    other, _ = model.validation_scores(model.predict(validation, model.train(training)))
    sizes = parts.agg(
        F.count_if(F.col("part") == corpus.TRAIN).alias("n_train"),
        F.count_if(F.col("part") == corpus.VALIDATION).alias("n_validation"),
    )
    return sizes.select(
        "*",
        F.lit(1 <= len(chosen.history) <= epochs.EPOCHS).alias("epochs_in_bounds"),
        F.lit(abs(min(h[1] for h in chosen.history) - loss) < 1e-9).alias("best_has_least_loss"),
        F.lit(loss <= other).alias("not_worse"),
        F.lit(accuracy >= LEAST_ACCURACY).alias("accurate"),
    )


@query
def score_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL scored by a pipeline, and whether score and class fit together."""
    fitted = model.train(_only(_split(spark, sf_dir), corpus.TRAIN), max_iter=5)
    scored = scoring.score_urls(fx.url_corpus_raw(spark, sf_dir), fitted)
    malicious = F.col("classification") == score.MALICIOUS
    fits = F.when(malicious, F.col("score") >= 0.5).otherwise(F.col("score") <= 0.5)
    return scored.select("url", F.coalesce(fits & F.col("score").between(0, 1), F.lit(False)).alias("fits"))


@query
def score_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.url_corpus_raw(spark, sf_dir)
    scored = scoring.score_urls(rows, _saved_table(spark, sf_dir))
    return scored.select("url", "score", "classification")


@query
def score_urls_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for a table that is too large to broadcast."""
    large = scoring.table_model(_saved_table(spark, sf_dir), broadcast_rows=5)
    scored = scoring.score_urls(fx.url_corpus_raw(spark, sf_dir), large)
    return scored.select("url", "score", "classification")


@query
def score_user_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load() -> Callable[[list[str]], list[float]]:
        """Stands for a user's model: the share of digits among a URL's characters."""

        def predict(texts: list[str]) -> list[float]:
            characters = [t.split(" ") for t in texts]
            return [sum(c in "0123456789" for c in cs) / len(cs) for cs in characters]

        return predict

    scorer = scoring.batch_scorer(load)
    scored = scoring.score_urls(fx.url_corpus_raw(spark, sf_dir), scorer, threshold=0.1)
    return scored.select("url", "score", "classification")


# URLs per second that the deployed scorer is said to reach.
REFERENCE_RATE = 200


@query
def score_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all messy URLs, and whether scoring them kept up with ``REFERENCE_RATE``."""
    urls = stored(fx.messy_urls(spark, sf_dir), "urls")
    learned = scoring.table_model(_saved_table(spark, sf_dir))
    start = time.monotonic()
    scored = stored(scoring.score_urls(urls, learned), "scored")
    counts = scored.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    rate = urls.count() / (time.monotonic() - start)
    return counts.withColumn("keeps_up", F.lit(rate >= REFERENCE_RATE))


# ------------------------------------------------------------------ evaluation


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


RATES = ("accuracy", "precision", "recall", "f1")


@query
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(fx.scored_rows(spark, sf_dir))


@query
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = evaluation.metrics(fx.scored_rows(spark, sf_dir))
    return _rounded(measured, *RATES, "auc_roc", "average_precision", "loss")


# Bounds as a table with many distinct scores gets them, for rows of which some have no score
# and most have the same.
BOUNDS = [0.1, 0.2, 0.25, 0.4, 0.8]


@query
def eval_metrics_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = evaluation.metrics(fx.hot_scored_rows(spark, sf_dir), bounds=BOUNDS)
    return _rounded(measured, *RATES, "auc_roc", "average_precision", "loss")


@query
def eval_curves_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(fx.hot_scored_rows(spark, sf_dir), BOUNDS)


@query
def eval_box_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(fx.hot_scored_rows(spark, sf_dir), BOUNDS)


@query
def eval_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluation.confusion(fx.scored_rows(spark, sf_dir))
    return _rounded(evaluation.class_report(counts), "precision", "recall", "f1")


def _curves(rows: DataFrame, bounds: list[float] | None = None, thinned: bool = False) -> DataFrame:
    """Both curves from one count of the rows."""
    found = evaluation.counted(rows, bounds)
    roc = evaluation.roc_curve(found, thinned=thinned).select(
        F.lit("roc").alias("curve"), F.col("fpr").alias("x"), F.col("tpr").alias("y"), "threshold"
    )
    pr = evaluation.pr_curve(found, thinned=thinned).select(
        F.lit("pr").alias("curve"), F.col("recall").alias("x"), F.col("precision").alias("y"),
        "threshold",
    )
    return _rounded(roc.unionByName(pr), "x", "y")


@query
def eval_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(fx.scored_rows(spark, sf_dir))


@query
def eval_curves_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the curves, also with the rows' scores in buckets."""
    rows = fx.scored_rows(spark, sf_dir)
    forms = {"plain": None, "bucketed": BOUNDS}
    plain, bucketed = (
        _curves(rows, bounds, thinned=True).withColumn("form", F.lit(form)) for form, bounds in forms.items()
    )
    return plain.unionByName(bucketed)


@query
def eval_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = evaluation.threshold_sweep(fx.scored_rows(spark, sf_dir))
    return _rounded(sweep, "threshold", *RATES)


@query
def eval_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = evaluation.threshold_sweep(fx.scored_rows(spark, sf_dir))
    return _rounded(evaluation.best_threshold(sweep), "threshold", *RATES)


@query
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.scored_rows(spark, sf_dir)
    found = evaluation.error_examples(rows).join(F.broadcast(evaluation.error_stats(rows)), "kind")
    return _rounded(found, "score", "mean_score")


@query
def eval_hist60(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = evaluation.score_histogram(fx.scored_rows(spark, sf_dir))
    return _rounded(bins, "bin_start", "bin_end")


def _boxes(rows: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    boxes = evaluation.box_stats(rows, bounds=bounds)
    return _rounded(boxes, *[c for c in boxes.columns if c not in ("outcome", "n")])


@query
def eval_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(fx.scored_rows(spark, sf_dir))


@query
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(evaluation.confusion(fx.scored_rows(spark, sf_dir)))


@query
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = evaluation.rates(evaluation.confusion(fx.scored_rows(spark, sf_dir)))
    return _rounded(evaluation.compare(measured), "Score")


# ------------------------------------------------------------------ streaming


@query
def stream_minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "minutes")
    rows = fx.classify_events(spark, sf_dir, fx.read_events_stream(spark, sf_dir))
    jobs.drain(
        jobs.minute_counts_stream(
            rows.select("time_added", "classification"), path,
            shared_dir(spark, "checkpoint"), REPLAY_DELAY,
        )
    )
    return text.iso_columns(jobs.current_minute_counts(spark, path))


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "scored")
    stream = fx.envelopes(spark, sf_dir, fx.read_events_stream(spark, sf_dir))
    learned = _saved_table(spark, sf_dir)
    jobs.drain(jobs.score_stream(stream, learned, path, shared_dir(spark, "checkpoint")))
    return table.read_classified(spark, path).select("url", "score", "classification")


@query
def stream_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "dead")
    stream = fx.envelopes(spark, sf_dir, fx.read_events_stream(spark, sf_dir))
    decoded = messages.decode_envelopes(stream).select("event_id", "error")
    jobs.drain(jobs.dead_letter_stream(decoded, path, shared_dir(spark, "checkpoint")))
    return read_batches(spark, path, "event_id bigint, error string").drop("run", "batch")


@query
def stream_minute_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed minutes by day and open ones from the state, over several micro-batches."""
    path, checkpoint = (shared_dir(spark, n) for n in ("minutes", "checkpoint"))
    rows = fx.classified_urls(spark, sf_dir).select(F.col("time_added").alias("ts"), F.col("classification").alias("value"))
    for source in _parts_in_time(spark, "classified", rows):
        stream = _timed_stream(spark, source).toDF("time_added", "classification")
        jobs.drain(jobs.minute_finals_stream(stream, path, checkpoint))
    return text.iso_columns(jobs.minutes_so_far(spark, path))


def _published(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, "value string", "text").select("value")


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the certificate path over several micro-batches."""
    path, checkpoint = shared_dir(spark, "ingested"), shared_dir(spark, "checkpoint")
    for source in _parts_in_time(spark, "messages", fx.ct_messages(spark, sf_dir).select("ts", "value")):
        lists = jobs.names_of_messages(_timed_stream(spark, source))
        jobs.drain(jobs.certificate_stream(lists, path, checkpoint))
    return _published(spark, path)


def _search_run(
    spark: SparkSession, sf_dir: str, path: str, mark: str | None = None, after: str | None = None, parts: int = FILES
) -> str:
    """Both steps of the search path over all responses with new checkpoints; that of the second step."""
    staging, first, second = (shared_dir(spark, n) for n in ("staging", "checkpoint", "checkpoint"))
    if after:
        jobs.drain(jobs.seeded_stream(spark, after, staging, path, second, horizon=REPLAY_DELAY))
    for source in _parts_in_time(spark, "bodies", fx.ct_search_bodies(spark, sf_dir), parts):
        names = jobs.names_of_searches(_timed_stream(spark, source))
        jobs.drain(jobs.staged_domains(names, staging, first, mark))
        jobs.drain(jobs.ingest_stream(spark, staging, path, second, horizon=REPLAY_DELAY))
    return second


@query
def stream_ingest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the search path, and that its mark is the highest id, over several micro-batches."""
    path, mark = shared_dir(spark, "ingested"), shared_dir(spark, "mark")
    _search_run(spark, sf_dir, path, mark)
    return _published(spark, path).withColumn("mark", F.lit(ingest.load_mark(spark, mark)))


@query
def stream_ingest_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search path with a memory by count, over several micro-batches and restarts."""
    path, checkpoint = shared_dir(spark, "ingested"), shared_dir(spark, "checkpoint")
    for source in _parts_in_time(spark, "bodies", fx.ct_search_bodies(spark, sf_dir)):
        names = jobs.names_of_searches(_timed_stream(spark, source))
        jobs.drain(jobs.recent_stream(names, path, checkpoint, bound=RECENT))
    return _published(spark, path)


@query
def stream_replay_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search path read twice in whole, the second time with new checkpoints that take over the
    names of the first run: nothing is published again."""
    path = shared_dir(spark, "ingested")
    first = _search_run(spark, sf_dir, path, parts=2)
    _search_run(spark, sf_dir, path, after=first, parts=2)
    return _published(spark, path)


@query
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checkpoints into one folder, a part of the rows and all of them: the second run adds to the first."""
    path = shared_dir(spark, "scored")

    def by_length(url: Column) -> Column:
        return (F.length(url) % 100) / 100

    for part in ("event_id % 2 = 0", "true"):
        stream = fx.envelopes(spark, sf_dir, fx.read_events_stream(spark, sf_dir)).filter(part)
        jobs.drain(jobs.score_stream(stream, by_length, path, shared_dir(spark, "checkpoint")))
    return table.read_classified(spark, path).select("url", "score", "classification")


@query
def stream_counts_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts of a part of the rows, then of all of them again with a new checkpoint."""
    path = shared_dir(spark, "minutes")
    for part in ("event_id % 2 = 0", "true"):
        rows = fx.classify_events(spark, sf_dir, fx.read_events_stream(spark, sf_dir)).filter(part)
        jobs.drain(jobs.minute_counts_stream(
            rows.select("time_added", "classification"), path, shared_dir(spark, "checkpoint"), REPLAY_DELAY
        ))
    return text.iso_columns(jobs.current_minute_counts(spark, path))


def _event_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``events`` written again as ``FILES`` files."""
    fx.read(spark, sf_dir, "events").repartition(FILES, "event_id").write.parquet(path)


@query
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped source with a paced trigger: one file a batch, and batches a second apart."""
    source, path = shared_dir(spark, "files"), shared_dir(spark, "paced")
    _event_files(spark, sf_dir, source)
    schema = fx.read(spark, sf_dir, "events").schema
    stream = jobs.file_stream(spark, source, schema, files_per_trigger=1)

    def write(batch: DataFrame, folder: str) -> None:
        batch.select("event_id", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(folder)

    writer = keyed_writer(stream, path, shared_dir(spark, "checkpoint"), write)
    running = jobs.paced(writer, seconds=1).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    batches = read_batches(spark, path, "event_id bigint, at timestamp").groupBy("batch").agg(
        F.min("at").alias("at"), F.count(F.lit(1)).alias("n")
    )
    # The first batch starts at once, the second at the next full second.
    seconds = F.max("at").cast("double") - F.min("at").cast("double")
    return batches.agg(
        F.count(F.lit(1)).alias("batches"), F.sum("n").alias("n"),
        (seconds >= FILES - 2.5).alias("paced"),
    )


@query
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path = shared_dir(spark, "files"), shared_dir(spark, "resumed")
    checkpoint = shared_dir(spark, "checkpoint")
    schema = fx.read(spark, sf_dir, "events").schema
    halves = ("event_id % 2 = 0", "event_id % 2 = 1")
    for half in halves:
        fx.read(spark, sf_dir, "events").filter(half).write.mode("append").parquet(source)
        rows = fx.classify_events(spark, sf_dir, jobs.file_stream(spark, source, schema))
        feed = rows.select("event_id", *sink.COLUMNS)
        jobs.drain(jobs.alert_stream(feed, path, checkpoint))
    shape = "event_id bigint, url string, score double, classification string"
    return read_batches(spark, path, shape, "json").drop("run", "batch")
