"""Command line: ``spark-submit urlsight/__main__.py <command>`` or ``python -m urlsight``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.ml import PipelineModel  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.streaming import DataStreamWriter  # noqa: E402

from urlsight.functions.text import iso_columns  # noqa: E402
from urlsight.plans import dashboard, training  # noqa: E402
from urlsight.session import build_session  # noqa: E402
from urlsight.operators.ingest import load_mark  # noqa: E402
from urlsight.sinks import submissions  # noqa: E402
from urlsight.sources.messages import (  # noqa: E402
    decode_envelopes,
    newer_than,
    parse_ct_messages,
    parse_ct_search,
)
from urlsight.sources.table import read_classified, stream_classified  # noqa: E402
from urlsight.streaming import jobs  # noqa: E402

# Name and, where the answer depends on the current time, that it takes ``as_of``.
DASHBOARD = {
    "stats": (dashboard.stats, False),
    "realtime-metrics": (dashboard.realtime, True),
    "confidence-distribution": (dashboard.confidence, False),
    "timeline": (dashboard.timeline, True),
    "detection-rate": (dashboard.detection_rate, True),
    "top-domains": (dashboard.top_domains, False),
    "url-length": (dashboard.url_length, False),
    "data": (dashboard.recent, False),
    "top-malicious": (dashboard.top_malicious, False),
}


def ask(spark: SparkSession, name: str, path: str, as_of: datetime | None) -> DataFrame:
    """One dashboard answer over a stored table, as the records the dashboard is served."""
    question, timed = DASHBOARD[name]
    rows = read_classified(spark, path)
    return iso_columns(question(rows, as_of) if timed else question(rows))


def _run(spark: SparkSession, writers: list[DataStreamWriter], every: int | None) -> None:
    """Run writers to the end one after the other, or all at once until one of them fails."""
    if not every:
        for writer in writers:
            jobs.drain(writer)
        return
    queries = [jobs.paced(writer, every).start() for writer in writers]
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for query in queries:
            query.stop()
    for query in queries:
        if query.exception():
            raise query.exception()


def _messages(spark: SparkSession, args: argparse.Namespace, column: str, whole: bool = False) -> DataFrame:
    """Text files with one message per line, or per file, at most ``--files`` new files per batch."""
    stream = spark.readStream.format("text").option("wholetext", str(whole).lower())
    if args.files:
        stream = stream.option("maxFilesPerTrigger", args.files)
    return stream.load(args.input).select(F.col("value").alias(column))


def _timed(messages: DataFrame, path: str | None) -> DataFrame:
    """Add ``ts``: epoch seconds at a JSON path of the message, else the time of the batch."""
    now = F.current_timestamp()
    if not path:
        return messages.withColumn("ts", now)
    seconds = F.get_json_object("value", path).try_cast("double")
    return messages.withColumn("ts", F.coalesce(F.timestamp_seconds(seconds), now))


def _ingest(spark: SparkSession, args: argparse.Namespace) -> list[DataStreamWriter]:
    """The certificate path publishes every list; the search path filters, resumes and de-duplicates."""
    messages = _timed(_messages(spark, args, "value", whole=args.search), args.time)
    parse = parse_ct_search if args.search else parse_ct_messages
    writers = []
    if args.dead_letters:
        dead = parse(messages).select("value", "error")
        writers.append(jobs.dead_letter_stream(dead, args.dead_letters, f"{args.checkpoint}-dead"))
    if not args.search:
        return [*writers, jobs.certificate_stream(jobs.names_of_messages(messages), args.out, args.checkpoint)]
    mark, staging = f"{args.checkpoint}-mark", f"{args.checkpoint}-staging"
    if args.after:
        jobs.drain(jobs.seeded_stream(spark, args.after, staging, args.out, args.checkpoint))
    names = newer_than(jobs.names_of_searches(messages), None if args.again else load_mark(spark, mark))
    return [
        *writers,
        jobs.staged_domains(names, staging, f"{args.checkpoint}-staged", mark),
        jobs.ingest_stream(spark, staging, args.out, args.checkpoint),
    ]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="urlsight")
    commands = top.add_subparsers(dest="command", required=True)

    train = commands.add_parser("train", help="train on labelled URL lists and report")
    train.add_argument("--benign", required=True)
    train.add_argument("--malicious", required=True)
    train.add_argument("--out", required=True)
    train.add_argument("--max-rounds", type=int, default=20)

    report = commands.add_parser("evaluate", help="reports of stored predictions")
    report.add_argument("--predictions", required=True)
    report.add_argument("--out", required=True)

    for name, text in (
        ("ingest", "certificate messages to URL batches"), ("score", "URL envelopes to the table"),
    ):
        stream = commands.add_parser(name, help=text)
        stream.add_argument("--input", required=True)
        stream.add_argument("--out", required=True)
        stream.add_argument("--checkpoint", required=True)
        stream.add_argument("--every", type=int, help="seconds per batch; all at once if absent")
        stream.add_argument("--files", type=int, help="files per batch")
        stream.add_argument("--dead-letters", help="also keep what cannot be read here")
        if name == "ingest":
            stream.add_argument("--search", action="store_true", help="input is search responses, one a file")
            stream.add_argument("--again", action="store_true", help="search: do not resume from the saved mark")
            stream.add_argument("--after", help="search: checkpoint of an earlier run whose domains are not published again")
            stream.add_argument("--time", help="JSON path of the message's time in epoch seconds")
        else:
            stream.add_argument("--model", required=True)

    take = commands.add_parser("submit", help="add rows handed in by users to the table")
    take.add_argument("--input", required=True, help="text files, one JSON list per line")
    take.add_argument("--table", required=True)
    take.add_argument("--rejected", help="keep rejected requests here")

    feed = commands.add_parser("alerts", help="rows added to the table as a feed of JSON lines")
    feed.add_argument("--table", required=True)
    feed.add_argument("--out", required=True)
    feed.add_argument("--checkpoint", required=True)
    feed.add_argument("--every", type=int, help="seconds per batch; all at once if absent")

    show = commands.add_parser("dashboard", help="answer one monitoring question as JSON")
    show.add_argument("name", choices=sorted(DASHBOARD))
    show.add_argument("--table", required=True)
    show.add_argument("--as-of", type=datetime.fromisoformat)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    if args.command == "train":
        training.train_and_evaluate(
            spark, {args.benign: 0, args.malicious: 1}, args.out, max_rounds=args.max_rounds
        )
    elif args.command == "evaluate":
        training.write_reports(spark.read.parquet(args.predictions), args.out)
    elif args.command == "ingest":
        _run(spark, _ingest(spark, args), args.every)
    elif args.command == "score":
        writers = []
        if args.dead_letters:
            decoded = decode_envelopes(_messages(spark, args, "data")).select("data", "error")
            writers.append(jobs.dead_letter_stream(decoded, args.dead_letters, f"{args.checkpoint}-dead"))
        model = PipelineModel.load(args.model)
        writers.append(jobs.score_stream(_messages(spark, args, "data"), model, args.out, args.checkpoint))
        _run(spark, writers, args.every)
    elif args.command == "submit":
        rejected = submissions.submit(spark.read.text(args.input), args.table)
        if args.rejected:
            rejected.write.mode("append").parquet(args.rejected)
    elif args.command == "alerts":
        rows = stream_classified(spark, args.table)
        _run(spark, [jobs.alert_stream(rows, args.out, args.checkpoint)], args.every)
    else:
        # Every answer is an aggregate or a top-k, so it is small.
        answer = ask(spark, args.name, args.table, args.as_of)
        print(json.dumps([row.asDict() for row in answer.collect()]))


if __name__ == "__main__":
    main()
