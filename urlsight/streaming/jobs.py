"""The streaming side: paced sources, and writers that survive restarts.

Each job is returned as a writer that is not started yet, so the caller picks the
trigger; ``drain`` runs one until its source has nothing new. Every batch has a folder of its
own, named after the run of its checkpoint and its number: it replaces itself when it runs
again, and a new checkpoint adds to what earlier runs have written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from urlsight.functions.predicates import is_valid_domain
from urlsight.functions.rows import unnest
from urlsight.functions.text import certificate_names
from urlsight.operators.ingest import (
    drop_wildcards,
    explode_domains,
    first_seen,
    highest_id,
    published_counters,
    record_key,
    regroup,
    save_mark,
    write_counters,
)
from urlsight.operators.ranking import numbered
from urlsight.operators.recent import RECENT, published, remembered_after
from urlsight.operators.scoring import Model, TableModel, score_urls, table_model
from urlsight.sinks.batches import batch_path, keyed_writer, noted_run, read_batches, run_of
from urlsight.sinks.messages import alert_messages, url_messages
from urlsight.sinks.table import lay_out, with_day, write_batch
from urlsight.sources.messages import (
    dead_letters,
    decode_envelopes,
    good_rows,
    parse_ct_messages,
    parse_ct_search,
    search_records,
)

# Fixed value: messages per second of the certificate stream.
STREAM_RATE = 50


def file_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_format: str = "parquet",
    files_per_trigger: int | None = None,
    nested: bool = False,
) -> DataFrame:
    """New files of a folder as a stream, at most ``files_per_trigger`` per batch.

    With ``nested`` files in folders below count as well, and their names mean nothing.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if nested:
        reader = reader.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, rate: int = STREAM_RATE, seconds: int = 1
) -> DataFrame:
    """A topic as text messages, ``rate`` per second when triggered every ``seconds``.

    Needs the public Kafka connector on the session's class path.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", rate * seconds)
        .load()
        .select(F.col("value").cast("string").alias("value"), "timestamp")
    )


def paced(writer: DataStreamWriter, seconds: int = 1) -> DataStreamWriter:
    """One batch per ``seconds``; with a capped source this is the rate limit."""
    return writer.trigger(processingTime=f"{seconds} seconds")


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Run until everything available at the start is processed."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def score_stream(envelopes: DataFrame, model: Model, path: str, checkpoint: str) -> DataStreamWriter:
    """Envelopes to classified rows: decode, drop wildcards, score, append.

    With a pipeline, a scoring function or a log-odds table that fits in memory each row is
    scored by itself, one job per batch and no shuffle. A larger table is joined, and its size
    is read once, here. Envelopes that cannot be read are left to ``dead_letter_stream``.
    """
    names = unnest(good_rows(decode_envelopes(envelopes)).select("urls"), "urls", "url")
    if isinstance(model, DataFrame):
        model = table_model(model)
    joined = isinstance(model, TableModel) and model.score is None

    def write(batch: DataFrame, folder: str) -> None:
        scored = score_urls(batch, model)
        write_batch(lay_out(scored) if joined else with_day(scored), folder)

    return keyed_writer(drop_wildcards(names), path, checkpoint, write)


def dead_letter_stream(parsed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The rows a parser marked with an error, kept for inspection."""

    def write(batch: DataFrame, folder: str) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return keyed_writer(dead_letters(parsed), path, checkpoint, write)


def names_of_messages(messages: DataFrame, body: str = "value") -> DataFrame:
    """``(urls)``: all names of each certificate stream message, as they came."""
    updates = good_rows(parse_ct_messages(messages, body))
    return updates.select(F.col("all_domains").alias("urls"))


def names_of_searches(bodies: DataFrame, body: str = "value", time: str = "ts") -> DataFrame:
    """``(time, id, record, names)`` of certificate search responses."""
    records = search_records(parse_ct_search(bodies, body), time)
    names = certificate_names(F.col("name_value"), F.col("common_name"))
    key = record_key("id", "name_value", "common_name")
    return records.select(time, "id", key.alias("record"), names.alias("names"))


def _publish(lists: DataFrame, folder: str, counters: str) -> None:
    """Write a batch as messages; its counters are observed while it is written, in one pass.

    They are stored under the batch's own number, so a batch that runs again replaces its figures.
    A listener would hear of them later and only once, and lose them with the driver.
    """
    seen = Observation()
    listed = lists.filter(F.size("urls") > 0).observe(seen, *published_counters())
    url_messages(listed).write.mode("overwrite").text(folder)
    run, batch = folder.split("/")[-2:]
    write_counters(lists.sparkSession, seen.get, f"{counters}/{run}/{batch}")


def counters_of(path: str) -> str:
    """Where the counters of the messages in ``path`` are kept."""
    return f"{path.rstrip('/')}-counters"


def certificate_stream(lists: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The certificate stream's path: one message for each certificate, with all its names."""

    def write(batch: DataFrame, folder: str) -> None:
        _publish(batch, folder, counters_of(path))

    return keyed_writer(lists, path, checkpoint, write)


def staged_domains(
    names: DataFrame, staging: str, checkpoint: str, mark: str | None = None, time: str = "ts"
) -> DataStreamWriter:
    """The search path's first step: valid domains, each once a batch, with its earliest record.

    The minimum is combined before the shuffle, so a domain that fills a third of the stream
    costs one row a task, and one row a batch in the state of ``ingest_stream``. With ``mark``
    the highest record id of each batch is saved there for the next job to resume from.
    """

    def write(batch: DataFrame, folder: str) -> None:
        domains = explode_domains(batch.select(time, "record", "names"), "names")
        valid = domains.filter(is_valid_domain(F.col("domain")))
        first_seen(valid, "domain", [time, "record", "pos"]).write.mode("overwrite").parquet(folder)
        if mark:
            save_mark(highest_id(batch).filter("max_cert_id is not null"), mark)

    return keyed_writer(names, staging, checkpoint, write)


def unseen_domains(domains: DataFrame, time: str = "ts", horizon: str = "1 day") -> DataFrame:
    """Rows whose domain did not come up within the horizon of event time before.

    A domain is free again once the watermark has passed its last emission by the horizon;
    the watermark moves with the other rows, so on a quiet stream that may be later.
    """
    return domains.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["domain"])


def ingest_stream(
    spark: SparkSession, staging: str, path: str, checkpoint: str,
    time: str = "ts", horizon: str = "1 day", files_per_trigger: int | None = None,
) -> DataStreamWriter:
    """The second step: domains not seen lately, packed into one message for each record.

    Rows without a record only mark their domain as seen. A row without a time is
    published once a batch and not remembered.
    """
    schema = StructType.fromDDL(f"{time} timestamp, record string, pos int, domain string")
    # The folder must be there, even before the first step has written to it.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(batch_path(staging, "0", 0))
    staged = file_stream(spark, staging, schema, files_per_trigger=files_per_trigger, nested=True)

    def write(batch: DataFrame, folder: str) -> None:
        new = batch.filter(F.col("record").isNotNull())
        _publish(regroup(new, ["record"]), folder, counters_of(path))

    return keyed_writer(unseen_domains(staged, time, horizon), path, checkpoint, write)


def remembered_domains(spark: SparkSession, checkpoint: str, time: str = "ts", horizon: str = "1 day") -> DataFrame:
    """``(time, domain)`` that ``ingest_stream`` with this checkpoint still remembers, read from its state."""
    state = spark.read.format("statestore").load(checkpoint)
    expires = F.timestamp_micros(F.col("value.expiresAtMicros"))
    return state.select((expires - F.expr(f"interval {horizon}")).alias(time), F.col("key.domain").alias("domain"))


def seeded_stream(
    spark: SparkSession, after: str, staging: str, path: str, checkpoint: str,
    time: str = "ts", horizon: str = "1 day",
) -> DataStreamWriter:
    """``ingest_stream`` with a new checkpoint that takes over what the one ``after`` remembers.

    Drain it before anything is staged: the domains of the earlier run are then the first batch,
    which publishes nothing, and a replay of what that run has published is absorbed. The
    staging folder must be new. What follows costs no more than in any other run, because the
    domains are in the state of the new run, not looked up in the old one. With a checkpoint that
    is in use already it goes on where that is.
    """
    if not noted_run(spark, checkpoint):
        seeds = remembered_domains(spark, after, time, horizon).select(
            time, F.lit(None).cast("string").alias("record"), F.lit(0).alias("pos"), "domain"
        )
        seeds.write.mode("overwrite").parquet(batch_path(staging, "0", 0))
    return ingest_stream(spark, staging, path, checkpoint, time, horizon)


def _recent_state(spark: SparkSession, path: str, run: str, before: int | None) -> tuple[DataFrame | None, int]:
    """What a run remembered before a batch, or at its end, and the next number."""
    rows = read_batches(spark, path, "domain string, last bigint").filter(F.col("run") == run)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    # Batches follow one another, but one without rows may have been left out.
    latest = rows.agg(F.max("batch")).first()[0]
    if latest is None:
        return None, 0
    rows = rows.filter(F.col("batch") == latest)
    end = rows.filter("domain is null").first()["last"]
    return rows.filter("domain is not null").select("domain", "last"), end


def recent_stream(
    names: DataFrame, path: str, checkpoint: str, time: str = "ts", bound: int = RECENT, after: str | None = None
) -> DataStreamWriter:
    """The search path with a memory of ``bound`` names instead of a time.

    Valid names are numbered in the order of time, id and place, on from the batch before; a name is
    published unless it was published within the last ``bound`` numbers. The memory, at most ``bound``
    rows, is stored with each batch, so a batch that runs again finds what it found before. A new
    checkpoint starts without memory, or with that of the run of the checkpoint ``after``: a replay
    is absorbed as far back as the bound reaches.
    """
    spark, memory = names.sparkSession, f"{path.rstrip('/')}-recent"
    run, earlier = run_of(spark, checkpoint), noted_run(spark, after) if after else None

    def write(batch: DataFrame, folder: str) -> None:
        number = int(folder.rsplit("=", 1)[1])
        # The folder must be there, even before the first batch.
        nothing = spark.createDataFrame([], "domain string, last bigint")
        nothing.write.mode("ignore").parquet(batch_path(memory, "0", 0))
        remembered, start = _recent_state(spark, memory, run, number)
        if remembered is None and earlier:
            remembered, start = _recent_state(spark, memory, earlier, None)
        listed = explode_domains(batch.select(time, "id", "record", "names"), "names")
        valid = listed.filter(is_valid_domain(F.col("domain")))
        rows = numbered(valid, [time, "id", "record", "pos"], start=start)
        chosen = published(rows, bound, remembered)
        new = rows.join(chosen, ["domain", "number"])
        _publish(regroup(new, [time, "id", "record"]), folder, counters_of(path))
        end = start + rows.count()
        kept = remembered_after(chosen, end, bound, remembered)
        mark = spark.createDataFrame([(None, end)], "domain string, last bigint")
        kept.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(batch_path(memory, run, number))

    return keyed_writer(names, path, checkpoint, write)


def minute_counts(classified: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows per minute and class; a minute is kept open for ``delay`` of event time."""
    return (
        classified.withWatermark("time_added", delay)
        .groupBy(F.window("time_added", "1 minute"), "classification")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("time_bucket"), "classification", "count")
    )


def minute_counts_stream(
    classified: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes"
) -> DataStreamWriter:
    """Keeps the live counts per minute; each batch writes the minutes it changed, by day."""

    def write(batch: DataFrame, folder: str) -> None:
        days = batch.withColumn("dt", F.to_date("time_bucket"))
        days.write.mode("overwrite").partitionBy("dt").parquet(folder)

    return keyed_writer(minute_counts(classified, delay), path, checkpoint, write, mode="update")


def current_minute_counts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The latest state of every minute: that of the run begun last, and its last batch.

    ``since`` is the first day to read; older folders are left out of the scan.
    """
    schema = "time_bucket timestamp, classification string, count bigint, dt date"
    rows = read_batches(spark, path, schema)
    if since:
        rows = rows.filter(F.col("dt") >= F.lit(since).cast("date"))
    return rows.groupBy("time_bucket", "classification").agg(
        F.max_by("count", F.struct("run", "batch")).alias("count")
    )


def minute_finals_stream(
    classified: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes"
) -> DataStreamWriter:
    """Keeps the counts of closed minutes by day; those of open minutes stay in the query's state.

    A minute is written once, when the watermark has passed it. ``minutes_so_far`` adds the open ones.
    Minutes are shuffled by day, a file a day and batch: the state's partitions stay tasks of their own, and
    a day has no more rows than minutes and classes.
    """
    spark, run = classified.sparkSession, run_of(classified.sparkSession, checkpoint)
    # Noted again with every start; readers take each run once.
    noted = spark.createDataFrame([(checkpoint,)], "checkpoint string").coalesce(1)
    noted.write.mode("overwrite").parquet(f"{_open_minutes(path)}/run={run}")

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumns({"dt": F.to_date("time_bucket"), "run": F.lit(run), "batch": F.lit(number)})
        keyed.repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "dt", "run", "batch"
        ).parquet(path)

    counts = minute_counts(classified, delay)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def _open_minutes(path: str) -> str:
    return f"{path.rstrip('/')}-open"


MINUTES = "time_bucket timestamp, classification string, count bigint, run string, batch bigint"


def minutes_so_far(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """Counts of every minute, closed or open; of several runs that begun last has the say.

    Closed minutes are read from the folders of the wanted ``days`` only, open ones from the state
    of each run as of its last finished batch, so an answer costs the same however old the table is.
    """
    runs = spark.read.schema("checkpoint string, run string").parquet(_open_minutes(path)).collect()
    closed = _closed_minutes(spark, path, days)
    parts, finished = [], {}
    for run in runs:
        last = spark.read.format("state-metadata").load(run["checkpoint"]).agg(F.max("maxBatchId")).first()[0]
        if last is None:
            continue
        finished[run["run"]] = last
        state = spark.read.format("statestore").option("batchId", last).load(run["checkpoint"])
        parts.append(state.select(
            F.col("key.window.start").alias("time_bucket"), F.col("key.classification").alias("classification"),
            F.col("value.count").alias("count"), F.lit(run["run"]).alias("run"), F.lit(last).cast("bigint").alias("batch"),
        ))
    # A batch that is under way has its minutes written, but its state not finished: they are in the state before.
    known = F.lit(False)
    for name, last in finished.items():
        known = known | ((F.col("run") == name) & (F.col("batch") <= last))
    rows = closed.filter(known)
    for part in parts:
        if days:
            part = part.filter(F.to_date("time_bucket").cast("string").isin(days))
        rows = rows.unionByName(part)
    return rows.groupBy("time_bucket", "classification").agg(F.max_by("count", F.struct("run", "batch")).alias("count"))


def _closed_minutes(spark: SparkSession, path: str, days: list[str] | None) -> DataFrame:
    """Closed minutes; only the folders of the wanted days are listed."""
    reader = spark.read.schema(f"{MINUTES}, dt date").option("basePath", path)
    rows = spark.createDataFrame([], MINUTES)
    for folder in [path] if days is None else [f"{path}/dt={day}" for day in days]:
        try:
            rows = rows.unionByName(reader.parquet(folder).drop("dt"))
        except AnalysisException:
            # A day, or a table, without a closed minute has no folder.
            continue
    return rows


def alert_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """New rows as JSON lines in a feed folder, for whoever subscribes to it."""

    def write(batch: DataFrame, folder: str) -> None:
        alert_messages(batch).write.mode("overwrite").text(folder)

    return keyed_writer(rows, path, checkpoint, write)
