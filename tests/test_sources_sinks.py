import base64
import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from urlsight.operators import ingest
from urlsight.sinks import messages as out
from urlsight.sinks import reports, submissions
from urlsight.sinks import table as sink
from urlsight.sources import lines, messages, table


def frame(spark, bodies, name="value"):
    return spark.createDataFrame([(b,) for b in bodies], f"{name} string")


def test_labelled_lines(spark, tmp_path):
    content = {
        "good": b"  http://a.com \r\n\xff\xfeb.com\t\n\n   \n\xc2\xa0c.com\n",
        "bad": b"d.com\x0be.com\n\xef\xbf\xbdg.com\rh.com\n\xef\xbf\xbd\xffi.com",
    }
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    got = lines.read_labelled_lines(spark, {str(tmp_path / "good"): 0, str(tmp_path / "bad"): 1})
    assert sorted((r.url, r.label) for r in got.collect()) == sorted([
        ("http://a.com", 0), ("b.com", 0), ("c.com", 0),
        ("d.com\x0be.com", 1), ("�g.com", 1), ("h.com", 1), ("�i.com", 1),
    ])


def test_ct_messages(spark):
    update = {"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": ["a.com", "b.com"]}}}
    parsed = messages.parse_ct_messages(frame(spark, [
        json.dumps(update), json.dumps({"message_type": "heartbeat"}), "{}", "test message", "[1]",
        json.dumps({"message_type": "certificate_update"}),
        json.dumps({"message_type": "certificate_update", "data": {"leaf_cert": {}}}),
    ]))
    assert [r.all_domains for r in messages.good_rows(parsed).collect()] == [["a.com", "b.com"]]
    dead = {r.value: r.error for r in messages.dead_letters(parsed).collect()}
    assert sorted(dead.values()) == ["no domain list"] * 2 + ["not a JSON object"] * 2
    assert dead["test message"] == "not a JSON object"


def test_ct_search(spark):
    bodies = [
        ' [{"id": 1, "name_value": "a\\nb", "common_name": "c"}, {"id": 2}]',
        "[]", "<html/>", '{"id": 3}', "[1, 2]", "",
    ]
    parsed = messages.parse_ct_search(frame(spark, bodies))
    records = messages.search_records(parsed).orderBy("id").collect()
    assert [tuple(r) for r in records] == [(1, "a\nb", "c"), (2, None, None)]
    assert messages.dead_letters(parsed).count() == 4


def test_resume_mark(spark, tmp_path):
    records = spark.createDataFrame([(0,), (5,), (9,), (None,)], "id bigint")
    path = str(tmp_path / "mark")
    ingest.save_mark(ingest.highest_id(records.filter("id < 9")), path)
    mark = ingest.load_mark(spark, path)
    assert mark == 5
    assert [r.id for r in messages.newer_than(records, mark).collect()] == [9]
    ingest.save_mark(ingest.highest_id(records.filter("id > 100")), path)
    assert ingest.load_mark(spark, path) is None
    assert messages.newer_than(records, None).count() == 4
    assert messages.newer_than(records, 0).count() == 4


def test_envelopes(spark):
    def pack(content):
        return base64.b64encode(content).decode()

    cases = {
        "eyJ1cmxzIjpbImEiXX0=": ["a"],
        pack(b"{}"): [],
        pack(b'{"urls": ["a", "*.b"]}')[:8] + "\r\n" + pack(b'{"urls": ["a", "*.b"]}')[8:]: ["a", "*.b"],
        pack(b"test message"): None,
        pack(b'{"urls": ["\xff"]}'): None,
        pack(b'{"urls": [null]}'): None,
        "%%%": None,
        "": None,
    }
    parsed = messages.decode_envelopes(frame(spark, list(cases), "data"))
    good = {r.data: r.urls for r in messages.good_rows(parsed).collect()}
    assert good == {k: v for k, v in cases.items() if v is not None}
    assert messages.dead_letters(parsed).count() == 5


def classified(spark, days=3, per_day=40):
    return spark.range(days * per_day).select(
        F.concat(F.lit("http://u"), "id").alias("url"),
        ((F.col("id") % 100) / 100.0).alias("score"),
        F.when(F.col("id") % 2 == 0, "MALICIOUS").otherwise("BENIGN").alias("classification"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % days) * 86400).alias("time_added"),
    )


def test_table_layout_and_pruning(spark, tmp_path):
    path = str(tmp_path / "table")
    sink.write_classified(classified(spark), path)
    stored = table.read_classified(spark, path)
    assert stored.count() == 120
    assert {str(r.dt) for r in stored.select("dt").distinct().collect()} == {
        "2024-01-01", "2024-01-02", "2024-01-03",
    }
    recent = table.since(stored, datetime(2024, 1, 3, 12), "1 DAY")
    assert recent.count() == 40
    plan = recent._jdf.queryExecution().executedPlan().toString()
    # The runs that are read are a filter on partitions too.
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "isnotnull(dt" in pruned and ">= 2024-01-02" in pruned and "layout-" in pruned
    malicious = stored.filter(F.col("classification") == "MALICIOUS").select("url")
    plan = malicious._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(classification,MALICIOUS)" in plan
    assert "ReadSchema: struct<url:string,classification:string>" in plan


def test_since_keeps_the_bound_and_later_rows(spark):
    rows = [("2024-01-01 10:59:59",), ("2024-01-01 11:00:00",), ("2024-01-02 00:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("time_added"))
    assert table.since(df, datetime(2024, 1, 1, 12), "1 HOUR").count() == 2


def test_url_messages(spark):
    df = spark.createDataFrame([(["a", 'b"'],), ([],)], "urls array<string>")
    assert [json.loads(r.value) for r in out.url_messages(df).collect()] == [{"urls": ["a", 'b"']}]


def test_submissions_are_taken_whole_or_not_at_all(spark, tmp_path):
    row = {"url": "u", "score": 0.5, "classification": "BENIGN", "time_added": "2024-01-01T00:00:00"}
    bodies = [
        json.dumps([row, {"url": "v"}]),
        json.dumps([row, {**row, "score": "high"}]),
        json.dumps([{**row, "extra": 1}]),
        json.dumps([{**row, "time_added": "soon"}]),
        "no json", "[]",
    ]
    path = str(tmp_path / "table")
    rejected = submissions.submit(frame(spark, bodies), path)
    assert sorted(r.value for r in rejected.collect()) == sorted(bodies[1:5])
    stored = table.read_classified(spark, path).orderBy("url").collect()
    assert [(r.url, r.score) for r in stored] == [("u", 0.5), ("v", None)]


def test_batch_rows_and_submissions_add_up(spark, tmp_path):
    path = str(tmp_path / "table")
    sink.write_classified(classified(spark), path)
    sink.write_classified(classified(spark, days=1), path)
    row = {"url": "u", "score": 0.5, "classification": "BENIGN", "time_added": "2024-01-01T00:00:00"}
    submissions.submit(frame(spark, [json.dumps([row])]), path)
    assert table.read_classified(spark, path).count() == 161
    sink.write_classified(classified(spark, days=1), path, mode="overwrite")
    assert table.read_classified(spark, path).count() == 40


def test_no_mark_yet(spark, tmp_path):
    assert ingest.load_mark(spark, str(tmp_path / "none")) is None


def test_csv_report(spark, tmp_path):
    path = str(tmp_path / "report")
    reports.write_csv_report(spark.createDataFrame([("Accuracy", "0.9826")], "Metric string, Value string"), path)
    (part,) = [p for p in (tmp_path / "report").iterdir() if p.suffix == ".csv"]
    assert part.read_text() == "Metric,Value\nAccuracy,0.9826\n"


def test_shared_dir_uses_the_configured_folder(spark):
    from urlsight.session import CHECKPOINT_KEY, shared_dir

    configured = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    path = shared_dir(spark, "x")
    assert path != shared_dir(spark, "x")
    if configured:
        assert path.startswith(configured)


@pytest.mark.parametrize("name, kept", [("a.com", True), ("*.a.com", False)])
def test_wildcards(spark, name, kept):
    assert (ingest.drop_wildcards(frame(spark, [name], "url")).count() == 1) is kept
