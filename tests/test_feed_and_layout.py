"""A feed that publishes whole batches, and the layout of a streamed table."""

import os

import pytest
from pyspark.sql import functions as F

from urlsight.sinks import feed, layout
from urlsight.sinks.batches import batch_path, new_run
from urlsight.sinks.table import write_batch, write_classified, with_day
from urlsight.sources.table import read_classified
from urlsight.streaming import jobs

SHAPE = "n bigint"


def put(spark, folder, low, high):
    spark.range(low, high).toDF("n").repartition(3).write.mode("append").parquet(folder)


def subscribed(spark, path, **more):
    return sorted(r["n"] for r in feed.read_feed(spark, path, SHAPE, **more).collect())


def run_feed(spark, tmp_path, checkpoint="ck", **more):
    schema = spark.range(1).toDF("n").schema
    rows = jobs.file_stream(spark, str(tmp_path / "in"), schema)
    jobs.drain(feed.feed_stream(rows, str(tmp_path / "feed"), str(tmp_path / checkpoint), **more))


def test_batches_come_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "feed")
    assert subscribed(spark, path) == []
    put(spark, str(tmp_path / "in"), 0, 20)
    run_feed(spark, tmp_path)
    put(spark, str(tmp_path / "in"), 20, 25)
    run_feed(spark, tmp_path)
    run_feed(spark, tmp_path)
    assert subscribed(spark, path) == list(range(25))
    batches = feed.published_batches(spark, path).collect()
    assert sorted((b["batch"], b["rows"]) for b in batches) == [(0, 20), (1, 5)]
    assert subscribed(spark, path, after={batches[0]["run"]: 0}) == list(range(20, 25))
    # A new checkpoint is a run of its own, which adds.
    run_feed(spark, tmp_path, "other")
    assert subscribed(spark, path) == sorted([*range(25)] * 2)


def failing(step, mark):
    """A feed whose writer fails in one step while the file ``mark`` is there."""

    class Failing(feed.FeedWriter):
        def write(self, rows):
            rows = list(rows)
            if step == "task" and os.path.exists(mark) and any(r["value"] == '{"n":7}' for r in rows):
                raise RuntimeError("task lost")
            return super().write(iter(rows))

        def commit(self, messages, batchId):
            if step == "commit" and os.path.exists(mark):
                raise RuntimeError("commit lost")
            super().commit(messages, batchId)
            if step == "after" and os.path.exists(mark):
                raise RuntimeError("lost after the commit")

    class FailingFeed(feed.AlertFeed):
        writer = Failing

        @classmethod
        def name(cls):
            return f"failing-{step}"

    return FailingFeed


@pytest.mark.parametrize("step", ["task", "commit", "after"])
def test_a_reader_never_sees_half_a_batch(spark, tmp_path, step):
    path, mark = str(tmp_path / "feed"), str(tmp_path / "fail")
    put(spark, str(tmp_path / "in"), 0, 5)
    run_feed(spark, tmp_path, source=failing(step, mark))
    put(spark, str(tmp_path / "in"), 5, 30)
    open(mark, "w").close()
    with pytest.raises(Exception, match="lost"):
        run_feed(spark, tmp_path, source=failing(step, mark))
    seen = subscribed(spark, path)
    assert seen == (list(range(30)) if step == "after" else list(range(5)))
    os.unlink(mark)
    run_feed(spark, tmp_path, source=failing(step, mark))
    assert subscribed(spark, path) == list(range(30))


def scored(spark, rows):
    return spark.createDataFrame(rows, "url string, score double, classification string, t string").select(
        "url", "score", "classification", F.col("t").cast("timestamp").alias("time_added")
    )


def rows_of(spark, path):
    return sorted(map(tuple, read_classified(spark, path).select("url", "score", "dt").collect()))


def files_of(spark, path, day):
    rows = read_classified(spark, path).filter(F.col("dt") == day)
    return rows.select("_metadata.file_path").distinct().count()


def stream_batches(spark, path, run, low, high, days=("01", "02", "03")):
    for k in range(low, high):
        rows = [(f"u{run}-{k}-{d}-{i}", i / 10, "BENIGN", f"2024-01-{d} 0{i}:00:00") for d in days for i in range(4)]
        write_batch(with_day(scored(spark, rows)).repartition(2), batch_path(path, run, k))


def test_closed_days_are_laid_out_and_nothing_else_changes(spark, tmp_path):
    path, run = str(tmp_path / "table"), new_run()
    stream_batches(spark, path, run, 0, 8)
    before, many = rows_of(spark, path), files_of(spark, path, "2024-01-01")
    assert many >= 8
    assert layout.lay_out_closed_days(spark, path, "2024-01-03") == 2 * 4 * 7  # the newest batch waits
    assert rows_of(spark, path) == before
    # One file of the laid out day, and what the newest batch has.
    assert files_of(spark, path, "2024-01-01") <= 3
    assert files_of(spark, path, "2024-01-03") == many
    # Again: nothing is left to do. More batches, late rows of closed days among them, then the next job.
    assert layout.lay_out_closed_days(spark, path, "2024-01-03") == 0
    stream_batches(spark, path, run, 8, 12)
    write_classified(scored(spark, [("batch", 0.5, "BENIGN", "2024-01-02 10:00:00")]), path)
    before = rows_of(spark, path)
    assert layout.lay_out_closed_days(spark, path, "2024-01-04") == 3 * 4 * 4 + 7 * 4 + 1
    assert rows_of(spark, path) == before
    assert files_of(spark, path, "2024-01-01") <= 5
    # What was taken over is left out of the scan by its folders.
    plan = read_classified(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "layout-" in plan
    assert layout.drop_laid_out(spark, path) > 0
    assert rows_of(spark, path) == before


def test_a_job_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    path, run = str(tmp_path / "table"), new_run()
    stream_batches(spark, path, run, 0, 3)
    before = rows_of(spark, path)

    def broken(*_):
        raise RuntimeError("broken off")

    with monkeypatch.context() as patch:
        patch.setattr(layout, "_note", broken)
        with pytest.raises(RuntimeError):
            layout.lay_out_closed_days(spark, path, "2024-01-03")
    assert rows_of(spark, path) == before
    assert layout.lay_out_closed_days(spark, path, "2024-01-03") == 2 * 4 * 2
    assert rows_of(spark, path) == before


def test_an_empty_or_missing_table(spark, tmp_path):
    assert layout.lay_out_closed_days(spark, str(tmp_path / "none"), "2024-01-03") == 0
