"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.llm import (
    block_dedup, exact_dedup, hard_negatives, licenses, mixing, packing, pii, quality, secrets, sharding, simhash,
    spelling, suffix_dedup,
)
from urlsight.llm.stored import documents, stored

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(simhash.fingerprints(documents(spark, sf_dir).select("doc_id", "text"), name="print"))
    found = simhash.cluster(prints, name="print")
    return found.select("doc_id", simhash.hexadecimal("print").alias("fingerprint"), "component_id")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(packing.pieces(documents(spark, sf_dir), tokenizer_path(), with_ids=False))
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(spark, sf_dir).select("doc_id", "text"))

    def of(*kinds: str):
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(of(*pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("findings")).alias("spans"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.transform("base_places", lambda p: p["label"])
    starts = F.transform("base_places", lambda p: p["word"])
    more = F.transform("hits", lambda h: h["label"])

    def listed(labels):
        return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))

    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"), "score",
    )


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir)).drop("key")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))

    def of(*kinds: str):
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.listed(of(*secrets.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("findings")).alias("spans"),
    )


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(documents(spark, sf_dir))


def hard_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=shifted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": near_duplicates,
    "op2_best_fit_packing": packed,
    "op3_pii": personal_data,
    "op4_suffix_dedup": repeated_bytes,
    "op5_exact_dedup": exact_duplicates,
    "op6_license_scan": license_scan,
    "op7_sampled_shards": sharded,
    "op8_quality_rules": quality_rules,
    "op9_block_dedup": repeated_words,
    "op10_weighted_mix": mixed,
    "op11_secrets": secret_scan,
    "op12_spelling_variants": spelling_variants,
    "op13_hard_negatives": hard_negative_pairs,
}
