"""Intermediate tables that survive a lost executor, and names that cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from urlsight.session import CHECKPOINT_KEY, shared_dir


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get(CHECKPOINT_KEY, None) or shared_dir(df.sparkSession, "checkpoints")
        context.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``stored``, but as compressed Parquet, for rows that hold text."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(name: str) -> str:
    """A column name quoted, so that dots and spaces in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def by_place(df: DataFrame, names: list[str], **more: Column) -> DataFrame:
    """The columns ``names`` as ``__0``, ``__1`` and so on, and some more.

    Functions over batches can't take columns with dots in their names.
    """
    return df.select(
        *[F.col(plain(name)).alias(f"__{k}") for k, name in enumerate(names)],
        *[value.alias(name) for name, value in more.items()],
    )


def identified(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(row, id, key)``: whole rows, each with its id and a hash of its text to find it again by.

    All columns lie in ``row``, so whatever their names are they clash with nothing.
    """
    whole = F.struct(*[F.col(plain(c)) for c in docs.columns])
    return docs.select(whole.alias("row"), F.col(plain(id)).alias("id"), F.xxhash64(F.col(plain(text))).alias("key"))


def found_again(docs: DataFrame, stays: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``stays(id, key)`` lists, of repeated rows one."""
    rows = identified(docs, id, text).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("s.id")) & F.col("d.key").eqNullSafe(F.col("s.key"))
    return rows.join(stays.alias("s"), same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; ``df`` should be stored."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def extended(df: DataFrame, ddl: str, without: tuple[str, ...] = ()) -> StructType:
    """The schema of ``df`` without some columns and with those of a DDL string after it."""
    kept = [f for f in df.schema.fields if f.name not in without]
    return StructType([*kept, *StructType.fromDDL(ddl).fields])
