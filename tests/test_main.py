import base64
import json

import pytest

from urlsight.__main__ import _timed, main
from urlsight.operators import ingest
from urlsight.sources.table import read_classified
from urlsight.streaming import jobs


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("train")
    (folder / "good").write_text("\n".join(f"http://site{i}.org/a/{i}" for i in range(60)))
    (folder / "bad").write_text("\n".join(f"http://evil{i}.biz/login/{i}" for i in range(60)))
    main(["train", "--benign", str(folder / "good"), "--malicious", str(folder / "bad"),
          "--out", str(folder / "out"), "--max-rounds", "1"], spark)
    return folder / "out"


def test_train_score_and_ask(spark, trained, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    batch = {"urls": ["http://evil7.biz/login/7", "*.x.com", "http://site3.org/a/3"]}
    lines = [base64.b64encode(json.dumps(batch).encode()).decode(), "%%%"]
    (source / "m.txt").write_text("\n".join(lines))
    table = str(tmp_path / "table")
    main(["score", "--input", str(source), "--out", table, "--checkpoint", str(tmp_path / "ck"),
          "--model", str(trained / "model"), "--dead-letters", str(tmp_path / "dead")], spark)
    assert read_classified(spark, table).count() == 2
    assert spark.read.schema("data string").parquet(str(tmp_path / "dead")).first().data == "%%%"
    capsys.readouterr()
    main(["dashboard", "stats", "--table", table], spark)
    (row,) = json.loads(capsys.readouterr().out)
    assert (row["total_urls"], row["total_malicious"], row["malicious_rate"]) == (2, 1, 50.0)
    main(["dashboard", "realtime-metrics", "--table", table], spark)
    assert json.loads(capsys.readouterr().out)[0]["total_last_hour"] == 2


def test_evaluate(spark, trained, tmp_path):
    main(["evaluate", "--predictions", str(trained / "predictions"), "--out", str(tmp_path)], spark)
    rows = spark.read.option("header", True).csv(str(tmp_path / "evaluation_summary")).collect()
    assert rows[0].Count == "24"


def test_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    body = {"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": ["a.com", "*.b.com"]}}}
    (source / "m.txt").write_text(json.dumps(body) + "\n")
    main(["ingest", "--input", str(source), "--out", str(tmp_path / "out"),
          "--checkpoint", str(tmp_path / "ck")], spark)
    # All names of a certificate are published, as they came.
    assert published(spark, tmp_path / "out") == [["a.com", "*.b.com"]]


def published(spark, path):
    return sorted(json.loads(r.value)["urls"] for r in spark.read.text(str(path)).collect())


def test_search_ingest_resumes_from_its_mark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run(*more):
        main(["ingest", "--search", "--input", str(source), "--out", str(tmp_path / "out"),
              "--checkpoint", str(tmp_path / "ck"), "--dead-letters", str(tmp_path / "dead"), *more], spark)

    records = [{"id": 3, "name_value": "a.com\n*.a.com", "common_name": "a.com"}, {"id": 4, "name_value": "See x.com"}]
    (source / "1.json").write_text(json.dumps(records, indent=2))
    (source / "2.json").write_text("<html/>")
    run()
    assert published(spark, tmp_path / "out") == [["a.com"]]
    assert spark.read.schema("value string, error string").parquet(str(tmp_path / "dead")).first().value == "<html/>"
    more = [{"id": 4, "name_value": "old.com"}, {"id": 5, "name_value": "a.com\nb.com"}]
    (source / "3.json").write_text(json.dumps(more))
    run()
    assert published(spark, tmp_path / "out") == [["a.com"], ["b.com"]]
    totals = ingest.published_so_far(spark, jobs.counters_of(str(tmp_path / "out"))).first()
    assert tuple(totals) == (2, 2)


def test_time_of_messages(spark):
    rows = spark.createDataFrame([('{"data": {"seen": 1704067200.5}}',), ("no json",)], "value string")
    first, second = (r.ts for r in _timed(rows, "$.data.seen").collect())
    assert first.timestamp() == 1704067200.5 and second > first


def test_submit_and_alerts(spark, tmp_path):
    row = {"url": "u", "score": 0.5, "classification": "BENIGN", "time_added": "2024-01-01T00:00:00"}
    (tmp_path / "requests").write_text(json.dumps([row, {**row, "url": "v"}]) + "\nno json\n")
    table, feed = str(tmp_path / "table"), str(tmp_path / "feed")
    main(["submit", "--input", str(tmp_path / "requests"), "--table", table,
          "--rejected", str(tmp_path / "rejected")], spark)
    assert read_classified(spark, table).count() == 2
    assert spark.read.parquet(str(tmp_path / "rejected")).first().value == "no json"
    for _ in range(2):
        main(["alerts", "--table", table, "--out", feed, "--checkpoint", str(tmp_path / "ck")], spark)
        assert sorted(json.loads(r.value)["url"] for r in spark.read.text(feed).collect()) == ["u", "v"]
