"""Memory by count, publisher batches, replays that are absorbed, and parts in the order of time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from urlsight import registry
from urlsight.operators import batching, ingest, recent
from urlsight.operators.ranking import numbered
from urlsight.streaming import jobs


def greedy(sizes, most, most_bytes):
    out, count, total = [], 0, 0
    for k, size in enumerate(sizes):
        if not count or count == most or total + size > most_bytes:
            out.append(k)
            count = total = 0
        count, total = count + 1, total + size
    return out


def batches_of(df):
    return sorted((r["batch"], r["n_messages"], r["n_bytes"], r["messages"]) for r in df.collect())


@pytest.mark.parametrize("stretch,chained", [(10_000, 1_000), (7, 3), (10, 1)])
def test_batches_are_those_of_one_publisher(spark, monkeypatch, stretch, chained):
    monkeypatch.setattr(batching, "STRETCH", stretch)
    monkeypatch.setattr(batching, "CHAINED", chained)
    draw = random.Random(stretch)
    texts = ["é" * draw.choice((0, 1, 3, 10, 40)) for _ in range(140)] + ["x" * 300, None, "x" * 100, "y"]
    rows = spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "number long, value string, batch string")
    got = batches_of(batching.message_batches(rows.repartition(4), most=5, most_bytes=100))
    sizes = [len((t or "").encode()) for t in texts]
    starts = greedy(sizes, 5, 100)
    assert [b[0] for b in got] == starts
    assert [t for b in got for t in b[3]] == texts
    for (low, n, size, _), high in zip(got, [*starts[1:], len(texts)]):
        assert n == high - low and size == sum(sizes[low:high])
        assert n <= 5 and (size <= 100 or n == 1)


def test_no_messages_and_one(spark):
    rows = spark.createDataFrame([(0, "one")], "number long, value string")
    assert batches_of(batching.message_batches(rows)) == [(0, 1, 3, ["one"])]
    assert batches_of(batching.message_batches(rows.limit(0))) == []


def test_numbers_follow_the_order_without_gaps(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("key"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("other"))
    got = numbered(rows.repartition(9), ["key", "other"], start=11).orderBy("key").collect()
    assert [r["number"] for r in got] == list(range(11, 5011))
    assert numbered(rows.limit(0), ["key"]).collect() == []


def offered(names, bound):
    last, out = {}, []
    for number, name in enumerate(names):
        if name not in last or number - last[name] >= bound:
            last[name] = number
            out.append((name, number))
    return out


@pytest.mark.parametrize("bound", [1, 5, 60, 5000])
def test_a_memory_by_count(spark, bound):
    draw = random.Random(bound)
    count = min(300, 8 * bound + 4)  # a round for each ``bound`` of them
    names = ["hot.com" if draw.random() < 0.3 else f"n{draw.randrange(40)}.com" for _ in range(count)]
    rows = spark.createDataFrame(list(enumerate(names)), "number long, domain string").repartition(2)
    got = sorted((r["domain"], r["number"]) for r in recent.published(rows, bound).collect())
    assert got == sorted(offered(names, bound))


def test_a_memory_is_taken_over_and_bounded(spark):
    names = [f"n{k % 40}.com" for k in range(100)]
    rows = spark.createDataFrame(list(enumerate(names)), "number long, domain string")
    first = recent.published(rows.filter("number < 50"), 30)
    memory = recent.remembered_after(first, 50, 30)
    assert memory.count() <= 30
    second = recent.published(rows.filter("number >= 50"), 30, memory)
    got = sorted((r["domain"], r["number"]) for r in first.unionByName(second).collect())
    assert got == sorted(offered(names, 30))
    assert recent.published(rows.limit(0), 30, memory).collect() == []


def response(*records):
    return json.dumps([{"id": i, "name_value": "\n".join(names)} for i, names in records])


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "value string, t string")
    df.select("value", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def published(spark, path):
    return sorted(json.loads(r["value"])["urls"] for r in spark.read.text(path).collect())


def stream_of(spark, folder):
    return jobs.names_of_searches(registry._timed_stream(spark, folder))


def test_a_stream_forgets_by_count_and_takes_over_a_memory(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint, after=None):
        jobs.drain(jobs.recent_stream(
            stream_of(spark, folder), path, str(tmp_path / checkpoint), bound=3, after=after and str(tmp_path / after)
        ))
        return published(spark, path)

    put(spark, folder, [(response((1, ["a.com", "b.com", "a.com"])), "2024-01-01 00:00:00")])
    assert run("one") == [["a.com", "b.com"]]
    put(spark, folder, [(response((2, ["b.com", "a.com"])), "2024-01-01 00:01:00")])
    # b.com is number 1 and 3, which is too near; a.com is number 0, 2 and 4: free again.
    assert run("one") == [["a.com"], ["a.com", "b.com"]]
    before = run("one")
    state = spark.read.parquet(f"{path}-recent")
    assert state.filter("domain is not null and batch = 1").count() <= 3
    # All of it again as one batch, numbers 5 to 9; the memory holds a.com (4) only. b.com (6) is free,
    # and so is the second a.com (7); the other two are too near to these.
    assert run("two", after="one") == sorted([*before, ["b.com", "a.com"]])


def search_run(spark, tmp_path, name, after=None):
    folder, path, staging = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"{name}-staging")
    checkpoint = str(tmp_path / name)
    if after:
        jobs.drain(jobs.seeded_stream(
            spark, str(tmp_path / after), staging, path, checkpoint, horizon="100 days"
        ))
    jobs.drain(jobs.staged_domains(stream_of(spark, folder), staging, str(tmp_path / f"{name}-first")))
    jobs.drain(jobs.ingest_stream(spark, staging, path, checkpoint, horizon="100 days"))
    return published(spark, path)


def test_a_replay_with_a_new_checkpoint_is_absorbed(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [(response((1, ["a.com", "b.com"])), "2024-01-01 00:00:00")])
    once = [["a.com", "b.com"]]
    assert search_run(spark, tmp_path, "one") == once
    assert search_run(spark, tmp_path, "two", after="one") == once
    # A restart with the same arguments goes on and does not seed again; new names come through.
    put(spark, folder, [(response((2, ["b.com", "c.com"])), "2024-01-02 00:00:00")])
    assert search_run(spark, tmp_path, "two", after="one") == [["a.com", "b.com"], ["c.com"]]
    # A third run takes over all that the second remembers, the names of the first included.
    assert search_run(spark, tmp_path, "three", after="two") == [["a.com", "b.com"], ["c.com"]]
    # Without a run to follow, everything is published again.
    assert len(search_run(spark, tmp_path, "four")) == 4
    counters = ingest.published_so_far(spark, jobs.counters_of(str(tmp_path / "out"))).first()
    assert tuple(counters) == (4, 6)


def test_names_without_a_time_are_published(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(response((1, ["a.com"])), None), (response((2, ["b.com"])), "2024-01-01 00:00:00")])
    assert search_run(spark, tmp_path, "one") == [["a.com"], ["b.com"]]


def test_parts_hold_all_rows_in_the_order_of_time(spark):
    rows = spark.createDataFrame(
        [(None, "no time")] * 3 + [(f"2024-01-0{1 + k % 9} 00:00:00", str(k)) for k in range(40)], "t string, value string"
    ).select(F.col("t").cast("timestamp").alias("ts"), "value")
    seen, latest = 0, None
    for folder in registry._parts_in_time(spark, "parts-test", rows):
        now = spark.read.parquet(folder)
        assert now.count() >= seen
        new = now.count() - seen
        seen = now.count()
        if latest is None:
            assert now.filter("ts is null").count() == 3
        latest = new
    assert seen == 43


@pytest.mark.parametrize("name", ["stream_ingest_recent", "ingest_counters", "sink_message_batches", "stream_replay_absorbed"])
def test_an_empty_table_publishes_nothing(spark, sf_dir, tmp_path, name):
    for table in ("events", "pages"):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (df.limit(0) if table == "events" else df).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert rows == [] or (name == "ingest_counters" and tuple(rows[0]) == (0, 0))


@pytest.mark.parametrize("bound,width", [(1, 10), (7, 70), (40, 400)])
def test_a_memory_by_count_over_many_stretches(spark, monkeypatch, bound, width):
    monkeypatch.setattr(recent, "STRETCH", width)
    draw = random.Random(bound)
    names = ["hot.com" if draw.random() < 0.3 else f"n{draw.randrange(90)}.com" for _ in range(9 * width + 5)]
    rows = list(enumerate(names, 3))
    df = spark.createDataFrame(rows, "number long, domain string").repartition(3)
    memory = [("hot.com", 2), ("n1.com", 3 - bound)]
    last = dict(memory)
    want = []
    for number, name in rows:
        if number - last.get(name, -bound) >= bound:
            last[name] = number
            want.append((name, number))
    got = recent.published(df, bound, spark.createDataFrame(memory, "domain string, last long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_the_jobs_do_not_grow_with_the_numbers(spark):
    """A bound that is passed many times; a round for each of them took jobs of its own."""
    rows = [(k, f"n{k % 13}.com" if k % 3 else "hot.com") for k in range(400)]
    df = spark.createDataFrame(rows, "number long, domain string").repartition(2)
    group = "rounds-of-the-bound"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = recent.published(df, 5).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == sorted(offered([name for _, name in rows], 5))
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 30


def test_a_large_batch_of_the_stream_takes_no_more_jobs(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    names = [f"n{k % 7}.com" if k % 3 else "hot.com" for k in range(240)]
    records = [(1 + k, [name]) for k, name in enumerate(names)]
    put(spark, folder, [(response(*records), "2024-01-01 00:00:00")])
    query = jobs.drain(jobs.recent_stream(stream_of(spark, folder), path, str(tmp_path / "ck"), bound=3))
    assert published(spark, path) == sorted([name] for name, _ in offered(names, 3))
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) < 60
    kept = spark.read.parquet(f"{path}-recent").filter("domain is not null").collect()
    last = {name: number for name, number in offered(names, 3) if number > len(names) - 3}
    assert {r["domain"]: r["last"] for r in kept} == last
