"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_local_bases: dict[str, str] = {}


def build_session(app: str = "urlsight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    Adaptive execution picks the number of reduce tasks and splits skewed join and
    write partitions, so only an upper start value for the shuffle is set here. On a
    cluster pass a higher ``spark.sql.shuffle.partitions`` (two to four per core).
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would not be seen by the other executors.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        app = context.applicationId
        if app not in _local_bases:
            _local_bases[app] = tempfile.mkdtemp(prefix="urlsight-")
        base = _local_bases[app]
    return f"{base.rstrip('/')}/urlsight/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` written once below the shared folder, for whoever reads them again."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
