"""One key with a third of all rows, or more: whole results, and the work is split."""

import os

from pyspark.sql import functions as F

from urlsight.functions import text
from urlsight.operators import corpus, features, ingest, model, scoring
from urlsight.plans import evaluation
from urlsight.sinks.table import write_classified

ROWS = 60_000


def hot_third(spark, hot, cold):
    return spark.range(0, ROWS, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit(cold), "id")).alias("url")
    )


def test_hot_url_in_the_corpus(spark):
    rows = hot_third(spark, "http://hot.com/a", "http://cold.com/").withColumn(
        "label", (F.col("id") % 2).cast("int")
    )
    unique = corpus.dedup_corpus(rows)
    assert unique.count() == 1 + ROWS - ROWS // 3
    assert unique.filter("url = 'http://hot.com/a'").first().label == 0


def test_hot_url_is_scored_in_every_row(spark):
    table = model.train_table(spark.createDataFrame(
        [("http://hot.com/a", 1), ("http://cold.com/1", 0)], "url string, label int"
    ))
    scored = scoring.score_urls(hot_third(spark, "http://hot.com/a", "http://cold.com/"), table)
    counts = {r.classification: r["n"] for r in scored.groupBy("classification").agg(F.count("*").alias("n")).collect()}
    assert counts == {"MALICIOUS": ROWS // 3, "BENIGN": ROWS - ROWS // 3}


def test_rows_of_a_hot_url_are_split_in_the_join(spark):
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    table = model.train_table(spark.createDataFrame([("http://hot.com/a", 1), ("x", 0)], "url string, label int"))
    table = scoring.table_model(table, broadcast_rows=0)
    rows = hot_third(spark, "http://hot.com/a", "http://cold.com/").withColumn(
        "note", F.sha2(F.col("id").cast("string"), 512)
    )
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        scored = scoring.score_with_table(rows, table)
        got = scored.collect()
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len({r.id for r in got}) == len(got) == ROWS
    assert "skew=true" in plan


def test_hot_score_is_one_row_after_counting(spark):
    df = spark.range(0, ROWS, 1, 8).select(
        F.col("id").cast("string").alias("url"),
        (F.col("id") % 2).cast("int").alias("truth"),
        F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.col("id") / ROWS).alias("score"),
    )
    counts = evaluation.score_counts(df)
    assert counts.filter("score = 0.25").first().pos + counts.filter("score = 0.25").first().neg >= ROWS // 3
    small = evaluation.metrics(df, bounds=[]).first()
    split = evaluation.metrics(df, bounds=[0.1, 0.25, 0.5, 0.9]).first()
    assert small.auc_roc == split.auc_roc and small.tp == split.tp


def test_hot_record_copies_collapse(spark):
    """A third of the records are copies of one certificate without an id."""
    records = hot_third(spark, "hot.com", "cold").select(
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"),
        F.col("url").alias("name_value"), F.concat("url", F.lit(".org")).alias("common_name"),
    )
    keyed = records.select(
        "id", ingest.record_key("id", "name_value", "common_name").alias("record"),
        text.certificate_names(F.col("name_value"), F.col("common_name")).alias("names"),
    )
    fresh = ingest.first_seen(ingest.explode_domains(keyed, "names"), "domain", ["id", "record", "pos"])
    packed = ingest.regroup(fresh, ["id", "record"])
    assert packed.agg(F.max(F.size("urls"))).first()[0] == 2
    assert packed.count() == 1 + ROWS - ROWS // 3


def test_hot_gram_in_the_model(spark):
    grams = features.gram_counts(hot_third(spark, "http://aaa.com", "http://bbb.com/"), widths=(3,))
    counts = {r.gram: r.n for r in grams.filter("gram in ('aaa', 'com')").collect()}
    assert counts == {"aaa": ROWS // 3, "com": ROWS}


def test_hot_day_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, ROWS, 1, 8).select(
        F.concat(F.lit("http://site.com/"), F.md5(F.col("id").cast("string"))).alias("url"),
        F.lit(0.4).alias("score"), F.lit("BENIGN").alias("classification"),
        F.timestamp_seconds(
            F.lit(1704067200) + F.when(F.col("id") % 3 > 0, 0).otherwise((F.col("id") % 20) * 86400)
        ).alias("time_added"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    try:
        write_classified(rows, str(tmp_path / "table"))
    finally:
        spark.conf.set(size, before)
    (batch,) = (tmp_path / "table").glob("run=*/batch=0")
    files = {
        day: sum(name.endswith(".parquet") for name in os.listdir(batch / day))
        for day in os.listdir(batch) if day.startswith("dt=")
    }
    assert files["dt=2024-01-01"] > 3
    assert min(files.values()) == 1
    assert spark.read.parquet(str(tmp_path / "table")).count() == ROWS
