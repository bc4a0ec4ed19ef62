"""Streams against their batch forms, restarts, late rows and hot keys."""

import base64
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from urlsight.functions.rows import unnest
from urlsight.operators import ingest, model
from urlsight.operators.scoring import score_urls, table_model
from urlsight.sinks.table import write_classified
from urlsight.sources import messages
from urlsight.sources.table import read_classified
from urlsight.streaming import jobs

TEXT = StructType([StructField("value", StringType())])
TIMED = StructType([StructField("value", StringType()), StructField("ts", TimestampType())])


def certificate(*names):
    return json.dumps({
        "message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": list(names)}},
    })


def put(spark, folder, rows, schema):
    """One more file in a source folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def urls_of(spark, path):
    return [json.loads(r.value)["urls"] for r in spark.read.text(path).collect()]




def stamp(spark, folder, rows):
    df = spark.createDataFrame(rows, "value string, t string")
    df.select("value", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def search(spark, tmp_path, checkpoint="ck", horizon="1 hour", mark=None):
    """Both steps of the search path over what is new in the folder ``in``."""
    source, staging, path = (str(tmp_path / n) for n in ("in", "staging", "out"))
    names = jobs.names_of_searches(jobs.file_stream(spark, source, TIMED))
    jobs.drain(jobs.staged_domains(names, staging, str(tmp_path / f"{checkpoint}-staged"), mark))
    jobs.drain(jobs.ingest_stream(spark, staging, path, str(tmp_path / checkpoint), horizon=horizon))
    return sorted(urls_of(spark, path))


def response(*records):
    return json.dumps([{"id": i, "name_value": "\n".join(names)} for i, names in records])


def test_certificates_are_published_whole(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    stamp(spark, source, [
        (certificate("visit.com", "*.a.com", "a.com"), "2024-01-01 00:00:00"),
        (certificate("a.com"), "2024-01-01 00:01:00"),
        ("test message", "2024-01-01 00:02:00"),
        (json.dumps({"message_type": "heartbeat"}), "2024-01-01 00:03:00"),
    ])
    lists = jobs.names_of_messages(jobs.file_stream(spark, source, TIMED))
    jobs.drain(jobs.certificate_stream(lists, path, checkpoint))
    assert sorted(urls_of(spark, path)) == [["a.com"], ["visit.com", "*.a.com", "a.com"]]


def test_search_drops_what_it_has_seen(spark, tmp_path):
    stamp(spark, str(tmp_path / "in"), [
        (response((1, ["a.com", "*.a.com", "b.com", "a.com"])), "2024-01-01 00:00:00"),
        (response((2, ["b.com", "Visit d.com"])), "2024-01-01 00:01:00"),
        ("<html/>", "2024-01-01 00:02:00"),
    ])
    assert search(spark, tmp_path) == [["a.com", "b.com"]]
    stamp(spark, str(tmp_path / "in"), [(response((3, ["a.com", "c.com"])), "2024-01-01 00:30:00")])
    assert search(spark, tmp_path) == [["a.com", "b.com"], ["c.com"]]
    assert search(spark, tmp_path) == [["a.com", "b.com"], ["c.com"]]


def test_the_earliest_record_is_credited(spark, tmp_path):
    stamp(spark, str(tmp_path / "in"), [
        (response((2, ["b.com", "a.com"])), "2024-01-01 00:01:00"),
        (response((1, ["a.com"])), "2024-01-01 00:00:00"),
    ])
    assert search(spark, tmp_path) == [["a.com"], ["b.com"]]


def test_a_domain_comes_again_after_the_horizon(spark, tmp_path):
    # The other domain moves the watermark on before a.com is back.
    for hour, name in (("00", "a.com"), ("03", "b.com"), ("05", "a.com")):
        stamp(spark, str(tmp_path / "in"), [(response((1, [name])), f"2024-01-01 {hour}:00:00")])
        found = search(spark, tmp_path)
    assert found == [["a.com"], ["a.com"], ["b.com"]]


def test_a_replay_of_the_first_step_is_absorbed(spark, tmp_path):
    source, staging, path = (str(tmp_path / n) for n in ("in", "staging", "out"))
    stamp(spark, source, [(response((1, ["a.com"])), "2024-01-01 00:00:00")])
    for checkpoint in ("ck1", "ck2"):
        names = jobs.names_of_searches(jobs.file_stream(spark, source, TIMED))
        jobs.drain(jobs.staged_domains(names, staging, str(tmp_path / checkpoint)))
        jobs.drain(jobs.ingest_stream(spark, staging, path, str(tmp_path / "ck")))
    assert spark.read.parquet(staging).count() == 2
    assert urls_of(spark, path) == [["a.com"]]


def test_the_mark_is_saved_with_each_batch(spark, tmp_path):
    mark = str(tmp_path / "mark")
    for ids in ((7, 3), (None, 0), (9,)):
        stamp(spark, str(tmp_path / "in"), [(response(*[(i, ["a.com"]) for i in ids]), "2024-01-01 00:00:00")])
        search(spark, tmp_path, mark=mark)
    assert ingest.load_mark(spark, mark) == 9


def test_a_hot_domain_is_one_row_in_the_state(spark, tmp_path):
    body = response(*[(i, ["hot.com"]) for i in range(200)])
    stamp(spark, str(tmp_path / "in"), [(body, "2024-01-01 00:00:00")] * 50)
    assert search(spark, tmp_path) == [["hot.com"]]
    assert spark.read.parquet(str(tmp_path / "staging")).count() == 1


def envelope(*urls):
    return base64.b64encode(json.dumps({"urls": list(urls)}).encode()).decode()


@pytest.fixture(scope="module")
def corpus_rows(spark):
    rows = [(f"http://site{i}.org/page", 0) for i in range(20)]
    rows += [(f"http://evil{i}.biz/login", 1) for i in range(20)]
    return spark.createDataFrame(rows, "url string, label int")


@pytest.mark.parametrize("kind", ["table", "large table", "pipeline", "function"])
def test_scoring_stream(spark, tmp_path, corpus_rows, kind):
    if kind == "table":
        fitted = model.train_table(corpus_rows)
    elif kind == "large table":
        fitted = table_model(model.train_table(corpus_rows), broadcast_rows=3)
    elif kind == "pipeline":
        fitted = model.train(corpus_rows, max_iter=3, features=1 << 10)
    else:
        def fitted(url):
            return F.when(url.contains("evil"), 0.9).otherwise(0.1)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = StructType([StructField("data", StringType())])

    def run():
        stream = jobs.file_stream(spark, source, schema)
        jobs.drain(jobs.score_stream(stream, fitted, path, checkpoint))

    put(spark, source, [(envelope("evil3.biz/login", "*.evil.biz"),), ("%%%",), (envelope(),)], schema)
    run()
    put(spark, source, [(envelope("site3.org/page", "evil4.biz/login"),)], schema)
    run()
    run()
    scored = read_classified(spark, path)
    assert sorted((r.url, r.classification) for r in scored.collect()) == [
        ("evil3.biz/login", "MALICIOUS"), ("evil4.biz/login", "MALICIOUS"), ("site3.org/page", "BENIGN"),
    ]


def test_dead_letters_are_kept(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = StructType([StructField("data", StringType())])
    put(spark, source, [(envelope("a.com"),), ("%%%",), (envelope(),)], schema)
    decoded = messages.decode_envelopes(jobs.file_stream(spark, source, schema))
    jobs.drain(jobs.dead_letter_stream(decoded.select("data", "error"), path, str(tmp_path / "ck")))
    dead = spark.read.schema("data string, error string").parquet(path).collect()
    assert [(r.data, r.error) for r in dead] == [("%%%", "not base64 of UTF-8 text")]


def test_scoring_each_row_by_itself_does_not_shuffle(spark, tmp_path, corpus_rows):
    fitted = model.train(corpus_rows, max_iter=1, features=1 << 8)
    rows = spark.createDataFrame([(envelope("a.com"),)], "data string")
    decoded = messages.good_rows(messages.decode_envelopes(rows))
    scored = score_urls(unnest(decoded.select("urls"), "urls", "url"), fitted)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_minute_counts_add_up_over_batches(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "classification string, time_added timestamp"

    def run(rows):
        df = spark.createDataFrame(rows, "classification string, t string")
        df.select("classification", F.col("t").cast("timestamp").alias("time_added")).coalesce(1).write.mode(
            "append"
        ).parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.drain(jobs.minute_counts_stream(stream, path, checkpoint, "10 minutes"))
        return {
            (r.time_bucket.minute, r.classification): r["count"]
            for r in jobs.current_minute_counts(spark, path).collect()
        }

    first = run([("MALICIOUS", "2024-01-01 00:00:01"), ("MALICIOUS", "2024-01-01 00:00:59"),
                 ("BENIGN", "2024-01-01 00:01:00")])
    assert first == {(0, "MALICIOUS"): 2, (1, "BENIGN"): 1}
    second = run([("MALICIOUS", "2024-01-01 00:00:30")])
    assert second == {(0, "MALICIOUS"): 3, (1, "BENIGN"): 1}


def test_a_replayed_minute_has_the_count_of_the_last_run(spark, tmp_path):
    """A new run starts its batches at 0 again, but it knows more than the run before."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "classification string, time_added timestamp"
    for number, checkpoint in enumerate(("ck1", "ck1", "ck2")):
        rows = spark.createDataFrame([("BENIGN", f"2024-01-01 00:00:0{number}")] * 5, "classification string, t string")
        rows.select("classification", F.col("t").cast("timestamp").alias("time_added")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.drain(jobs.minute_counts_stream(stream, path, str(tmp_path / checkpoint)))
    assert [r["count"] for r in jobs.current_minute_counts(spark, path).collect()] == [15]
    assert jobs.current_minute_counts(spark, path, since="2024-01-02").count() == 0


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    """After a crash between the write and the commit the batch is written once more."""
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    stamp(spark, source, [(certificate("a.com"), "2024-01-01 00:00:00")])

    def run():
        lists = jobs.names_of_messages(jobs.file_stream(spark, source, TIMED))
        jobs.drain(jobs.certificate_stream(lists, path, checkpoint))

    run()
    for commit in (tmp_path / "ck" / "commits").iterdir():
        commit.unlink()
    run()
    assert urls_of(spark, path) == [["a.com"]]
    assert tuple(ingest.published_so_far(spark, jobs.counters_of(path)).first()) == (1, 1)


def test_a_new_checkpoint_adds(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for name in ("first.com", "second.com"):
        folder = f"{source}-{name}"
        stamp(spark, folder, [(certificate(name), "2024-01-01 00:00:00")])
        lists = jobs.names_of_messages(jobs.file_stream(spark, folder, TIMED))
        jobs.drain(jobs.certificate_stream(lists, path, str(tmp_path / f"ck-{name}")))
    assert sorted(urls_of(spark, path)) == [["first.com"], ["second.com"]]
    assert tuple(ingest.published_so_far(spark, jobs.counters_of(path)).first()) == (2, 2)


def test_streamed_and_batch_rows_are_read_together(spark, tmp_path, corpus_rows):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    schema = StructType([StructField("data", StringType())])
    put(spark, source, [(envelope("a.com", "b.com"),)], schema)
    stream = jobs.file_stream(spark, source, schema)
    jobs.drain(jobs.score_stream(stream, lambda url: F.lit(0.9), path, str(tmp_path / "ck")))
    write_classified(read_classified(spark, path).limit(1), path)
    assert read_classified(spark, path).count() == 3


def test_paced_source_takes_one_file_per_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(40).select(F.col("id").cast("string").alias("value")).repartition(4, "value").write.parquet(source)
    stream = jobs.file_stream(spark, source, TEXT, files_per_trigger=1)
    writer = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck"))
    query = jobs.drain(writer)
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) == 4 and sum(sizes) == 40


def test_alerts(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    stamp(spark, source, [("u", "2024-01-01 00:00:00.5")])
    stream = jobs.file_stream(spark, source, TIMED)
    jobs.drain(jobs.alert_stream(stream, path, str(tmp_path / "ck")))
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [
        {"value": "u", "ts": "2024-01-01T00:00:00.500000+00:00"}
    ]
