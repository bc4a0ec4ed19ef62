"""The source with offsets, closed and open minutes, and thinned curves."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from urlsight.plans import evaluation
from urlsight.sinks.batches import keyed_writer, read_batches
from urlsight.sources import records
from urlsight.streaming import jobs


def put_records(spark, folder, ids):
    rows = [(i, f"n{i}", None) for i in ids]
    spark.createDataFrame(rows, "id long, name_value string, common_name string").repartition(2).write.mode("append").parquet(folder)


def copied(batch, folder):
    batch.write.mode("overwrite").parquet(folder)


def drain_records(spark, tmp_path, checkpoint="ck", **more):
    stream = records.record_stream(spark, str(tmp_path / "in"), **more)
    jobs.drain(keyed_writer(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), copied))
    return sorted(r["id"] for r in read_batches(spark, str(tmp_path / "out"), "id bigint").collect())


def test_a_restart_goes_on_after_the_highest_id(spark, tmp_path):
    folder = str(tmp_path / "in")
    put_records(spark, folder, [3, 1, 2, 2, None, 0, -4])
    assert drain_records(spark, tmp_path) == [1, 2, 2, 3]
    assert drain_records(spark, tmp_path) == [1, 2, 2, 3]
    # What comes late with a lower id is not asked for, as with a search from an id on.
    put_records(spark, folder, [2, 9, 7])
    assert drain_records(spark, tmp_path) == [1, 2, 2, 3, 7, 9]
    assert drain_records(spark, tmp_path, "other", start=7) == [1, 2, 2, 3, 7, 9, 9]


def test_ranges_of_ids_are_tasks(spark, tmp_path):
    reader = records.RecordReader(None, StructType(), 0, 10)
    parts = reader.partitions({"id": 5}, {"id": 31})
    assert [(p.low, p.high) for p in parts] == [(5, 15), (15, 25), (25, 31)]
    assert reader.partitions({"id": 5}, {"id": 5}) == []


def test_a_service_of_ones_own(spark, tmp_path):
    class Counting:
        def __init__(self, options):
            self.path = options["path"]

        def highest(self):
            return 25

        def between(self, low, high, names):
            import pyarrow as pa

            ids = list(range(low + 1, high + 1))
            yield pa.RecordBatch.from_pydict({"id": ids, "name_value": [str(i) for i in ids], "common_name": [None] * len(ids)},
                                             schema=pa.schema([("id", pa.int64()), ("name_value", pa.string()), ("common_name", pa.string())]))

    class CountingSource(records.RecordSource):
        service = Counting

        @classmethod
        def name(cls):
            return "counting-records"

    assert drain_records(spark, tmp_path, source=CountingSource) == list(range(1, 26))


def test_a_task_holds_few_rows_of_the_folder(tmp_path):
    names = ["id", "name_value", "common_name"]
    for start in (0, 150_000):
        ids = range(start + 1, start + 150_001)
        table = pa.table({"common_name": [None] * len(ids), "name_value": [f"{i:0200d}" for i in ids], "id": ids},
                         schema=pa.schema([("common_name", pa.string()), ("name_value", pa.string()), ("id", pa.int64())]))
        pq.write_table(table, tmp_path / f"{start}.parquet", row_group_size=150_000)
    del table
    service, before, most, seen = records.FolderService({"path": str(tmp_path)}), pa.total_allocated_bytes(), 0, []
    for batch in service.between(100_000, 200_000, names):
        assert batch.schema.names == names
        seen += batch["id"].to_pylist()
        most = max(most, pa.total_allocated_bytes() - before)
    assert sorted(seen) == list(range(100_001, 200_001))
    assert most < 16e6  # the rows asked for are 21 MB, those of the folder 62 MB
    assert [b["name_value"][0].as_py() for b in service.between(6, 7, ["name_value"]) if b.num_rows] == [f"{7:0200d}"]


MINUTES = StructType([StructField("time_added", TimestampType()), StructField("classification", StringType())])


def put_minutes(spark, folder, rows):
    df = spark.createDataFrame(rows, "t string, classification string")
    df.select(F.col("t").cast("timestamp").alias("time_added"), "classification").coalesce(1).write.mode("append").parquet(folder)


def count_minutes(spark, tmp_path, checkpoint="ck"):
    stream = jobs.file_stream(spark, str(tmp_path / "in"), MINUTES)
    jobs.drain(jobs.minute_finals_stream(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)))


def answer(spark, tmp_path, days=None):
    rows = jobs.minutes_so_far(spark, str(tmp_path / "out"), days).collect()
    return {(r["time_bucket"].strftime("%d %H:%M"), r["classification"]): r["count"] for r in rows}


def test_closed_minutes_and_open_ones_make_the_answer(spark, tmp_path):
    folder = str(tmp_path / "in")
    put_minutes(spark, folder, [("2024-01-01 00:00:10", "A"), ("2024-01-01 00:00:20", "A"), ("2024-01-01 00:01:00", "B")])
    count_minutes(spark, tmp_path)
    first = {("01 00:00", "A"): 2, ("01 00:01", "B"): 1}
    assert answer(spark, tmp_path) == first  # all of them open
    put_minutes(spark, folder, [("2024-01-01 00:05:10", "A"), ("2024-01-01 00:00:50", "A"), ("2024-01-02 07:00:00", "A")])
    count_minutes(spark, tmp_path)
    second = {("01 00:00", "A"): 3, ("01 00:01", "B"): 1, ("01 00:05", "A"): 1, ("02 07:00", "A"): 1}
    assert answer(spark, tmp_path) == second
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert closed.count() == 3 and closed.groupBy("time_bucket", "classification").count().filter("count > 1").isEmpty()
    assert answer(spark, tmp_path, ["2024-01-02"]) == {("02 07:00", "A"): 1}
    assert answer(spark, tmp_path, ["2024-01-01", "2023-01-01"]) == {k: v for k, v in second.items() if k[0] < "02"}
    # A run that begins later has the say, also over minutes that are open in it and closed before.
    count_minutes(spark, tmp_path, "again")
    assert answer(spark, tmp_path) == second


def test_old_days_cost_an_answer_nothing(spark, tmp_path):
    for day in range(1, 8):
        put_minutes(spark, str(tmp_path / "in"), [(f"2024-01-0{day} 0{h}:00:00", "A") for h in range(5)])
        count_minutes(spark, tmp_path)
    read = {}
    for day in (2, 6):
        rows = jobs._closed_minutes(spark, str(tmp_path / "out"), [f"2024-01-0{day}"])
        read[day] = len(rows.inputFiles())
    assert read[2] == read[6] <= 2
    assert sum(answer(spark, tmp_path).values()) == 35


def test_partitions_of_the_state_are_tasks(spark, tmp_path):
    """One task for all of them held the memory of every partition's aggregates."""
    put_minutes(spark, str(tmp_path / "in"), [(f"2024-01-0{d} 0{h}:00:00", "A") for d in (1, 2, 3) for h in range(9)])
    stream = jobs.file_stream(spark, str(tmp_path / "in"), MINUTES)
    query = jobs.drain(jobs.minute_finals_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")))
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.parquet(str(tmp_path / "out")).select("dt", "batch", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("dt", "batch").count().filter("count > 1").isEmpty()
    assert sum(answer(spark, tmp_path).values()) == 27


def test_a_batch_under_way_is_not_counted_twice(spark, tmp_path):
    folder = str(tmp_path / "in")
    put_minutes(spark, folder, [("2024-01-01 00:00:10", "A"), ("2024-01-01 03:00:00", "A")])
    count_minutes(spark, tmp_path)
    before = answer(spark, tmp_path)
    run = spark.read.parquet(str(tmp_path / "out")).first()["run"]
    ahead = spark.createDataFrame([("2024-01-01 03:00:00", "A", 1, "2024-01-01", run, 99)],
                                  "t string, classification string, count long, dt string, run string, batch long")
    ahead.withColumn("time_bucket", F.col("t").cast("timestamp")).drop("t").write.mode("append").partitionBy(
        "dt", "run", "batch").parquet(str(tmp_path / "out"))
    assert answer(spark, tmp_path) == before


def corners(rows):
    """The points of the curve at which its direction changes, and both ends."""
    steps = []
    for score in sorted({s for _, s in rows}, reverse=True):
        pos = sum(t for t, s in rows if s == score)
        steps.append((sum(s == score for _, s in rows) - pos, pos, score))
    points, x, y = [(0, 0, float("inf"))], 0, 0
    for k, (dx, dy, score) in enumerate(steps):
        x, y = x + dx, y + dy
        if k + 1 == len(steps) or dx * steps[k + 1][1] != dy * steps[k + 1][0]:
            points.append((x, y, score))
    return points


@pytest.mark.parametrize("bounds", [None, [0.1, 0.35, 0.36, 0.9]])
def test_a_thinned_curve_has_only_its_corners(spark, bounds):
    draw = random.Random(4)
    rows = [(draw.randint(0, 1), draw.randrange(60) / 60) for _ in range(150)]
    rows += [(t, 0.5) for t in (0, 1)] + [(t, 0.5 + k / 1000) for k in range(1, 9) for t in (0, 1) for _ in range(k)]
    df = spark.createDataFrame([("u", t, s) for t, s in rows], "url string, truth int, score double")
    negatives, positives = sum(t == 0 for t, _ in rows), sum(t for t, _ in rows)
    got = {(round(r["fpr"] * negatives), round(r["tpr"] * positives), r["threshold"])
           for r in evaluation.roc_curve(df, bounds=bounds, thinned=True).collect()}
    assert got == set(corners(rows))
    assert len(got) < evaluation.roc_curve(df, bounds=bounds).count()

    def area(points):
        ordered = sorted(points)
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(ordered, ordered[1:]))

    whole = {(round(r["fpr"] * negatives), round(r["tpr"] * positives)) for r in
             evaluation.roc_curve(df, drop_collinear=False).collect()}
    assert area({p[:2] for p in got}) == area(whole)
    recalls = Counter(r["recall"] for r in evaluation.pr_curve(df, bounds=bounds, thinned=True).collect())
    assert set(recalls) == {r["recall"] for r in evaluation.pr_curve(df).collect()}
    assert max(recalls.values()) <= 3


@pytest.mark.parametrize("bounds", [None, [0.2, 0.6]])
def test_nan_is_a_missing_score(spark, bounds):
    rows = [(k % 2, k / 100) for k in range(100)]
    shape = "url string, truth int, score double"
    missing = [spark.createDataFrame([("u", t, s) for t, s in rows] + [("u", 1, m), ("u", 0, m)], shape)
               for m in (None, float("nan"))]
    for figure in (evaluation.metrics, evaluation.roc_curve, evaluation.pr_curve, evaluation.box_stats):
        a, b = (sorted(map(tuple, figure(df, bounds=bounds).collect()), key=repr) for df in missing)
        assert a == b
    for figure in (evaluation.confusion, evaluation.threshold_sweep, evaluation.score_histogram,
                   evaluation.error_stats, evaluation.error_examples):
        a, b = (sorted(map(tuple, figure(df).collect()), key=repr) for df in missing)
        assert a == b
