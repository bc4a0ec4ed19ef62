"""From certificate messages to the domains worth scoring, and back to messages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.functions.predicates import is_wildcard
from urlsight.functions.rows import unnest
from urlsight.sinks.batches import read_batches


def record_key(*parts: str) -> Column:
    """A key of a record's whole content.

    Ids may be missing or repeated; the content key tells records apart all the same,
    and copies of a record share it.
    """
    fields = [F.coalesce(F.col(p).cast("string"), F.lit("\x1e")) for p in parts]
    return F.md5(F.concat_ws("\x1f", *fields))


def explode_domains(df: DataFrame, names: str, name: str = "domain") -> DataFrame:
    """One row per listed name, with its place ``pos`` in the list."""
    return unnest(df, names, name, "pos")


def drop_wildcards(df: DataFrame, name: str = "url") -> DataFrame:
    return df.filter(~is_wildcard(F.col(name)))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in the given order.

    A minimum over a struct is combined before the shuffle, so a key that fills a third
    of the input sends one row per task; ranking each key in a window would sort them all
    in one task.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest))
    return df.groupBy(key).agg(first.alias("_first")).select(key, "_first.*").select(*df.columns)


def regroup(df: DataFrame, record: list[str], name: str = "domain") -> DataFrame:
    """Domains packed back into one list per record, in their old places.

    ``record`` must identify one input record, so a list never grows beyond the list it
    came from; records that kept no domain are gone.
    """
    packed = F.sort_array(F.collect_list(F.struct("pos", name)))
    return df.groupBy(*record).agg(
        F.transform(packed, lambda entry: entry[name]).alias("urls")
    )


def highest_id(records: DataFrame) -> DataFrame:
    """The resume mark of a batch: its highest id; a missing or zero id does not count."""
    return records.agg(F.max(F.when(F.col("id") != 0, F.col("id"))).alias("max_cert_id"))


def save_mark(mark: DataFrame, path: str) -> None:
    """Add a resume mark to the log of marks; a NULL mark resets it."""
    mark.select("max_cert_id", F.current_timestamp().alias("saved_at")).write.mode(
        "append"
    ).parquet(path)


def load_mark(spark: SparkSession, path: str) -> int | None:
    """The mark saved last; none where no mark was ever saved."""
    try:
        log = spark.read.schema("max_cert_id bigint, saved_at timestamp").parquet(path)
    except AnalysisException:
        return None
    return log.agg(F.max_by("max_cert_id", "saved_at").alias("mark")).first()["mark"]


COUNTERS = "batches bigint, domains bigint"


def published_counters() -> list[Column]:
    """Number of messages and of the domains in them, over a column ``urls``."""
    return [
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum(F.size("urls")), F.lit(0)).cast("bigint").alias("domains"),
    ]


def write_counters(spark: SparkSession, figures: dict[str, int], path: str) -> None:
    """The counters of one batch of messages, next to those of all other batches and runs."""
    row = tuple(figures.get(name) or 0 for name in ("batches", "domains"))
    spark.createDataFrame([row], COUNTERS).coalesce(1).write.mode("overwrite").parquet(path)


def published_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Lifetime totals over every batch of every run."""
    counters = read_batches(spark, path, COUNTERS)
    return counters.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("batches", "domains")]
    )
