"""A training corpus from raw documents: filter, de-duplicate, mix and pack.

Every stage reads what the one before it kept, from Parquet in the shared folder, and all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urlsight.llm import exact_dedup, mixing, packing, quality, simhash
from urlsight.llm.queries import tokenizer_path
from urlsight.llm.stored import documents, stored
from urlsight.session import shared_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of the SimHash operator make: three words, two bits."""
    return simhash.keep_one(docs)


def weighed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that the mix repeats has a row for each time."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    pieces = stored(packing.pieces(docs, tokenizer_path(), keep=("source",), with_ids=False))
    return packing.pack(pieces)


STAGES = [
    ("quality", good),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixing", weighed),
    ("packing", sequences),
]

#: Suffix arrays, SimHash and best fit are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
