"""Exact duplicates, batch by batch against immutable snapshots.

A snapshot is a table of digest groups in buckets, with a static binary fuse
filter for each bucket. The digests of a new batch are grouped among themselves first; the
filters then screen the groups, and only those they cannot rule out join the snapshot's exact
buckets. Texts behind one digest are compared byte by byte.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.llm import arrays, fuse
from urlsight.llm.stored import found_again, plain, small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(arrays)
cloudpickle.register_pickle_by_value(fuse)

BUCKET_KEYS = 100_000
#: Shared digests that are broadcast to find their texts; more are joined by a shuffle.
MOST_BROADCAST = 200_000
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space, as bytes; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary")


@dataclass
class Snapshot:
    """``groups``: digest, n, best (the row that stays), bucket. ``filters``: bucket, filter."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def snapshot(groups: DataFrame, incoming: int = 0) -> Snapshot:
    """Freeze groups: buckets by a hash of the digest, one filter each, built where the bucket lies.

    A bucket holds about ``BUCKET_KEYS`` groups, and is asked for as many of ``incoming`` ones.
    """
    count = max(groups.count(), incoming)
    buckets = max(1, math.ceil(count / BUCKET_KEYS))
    placed = stored(groups.withColumn("bucket", _bucket(buckets)))

    def built(part: pa.Table) -> pa.Table:
        return pa.table({"bucket": part["bucket"][:1], "filter": pa.array([fuse.build(_numbers(part["key"]))], pa.binary())})

    filters = stored(
        placed.select("bucket", _key().alias("key")).groupBy("bucket")
        .applyInArrow(built, "bucket long, filter binary")
    )
    return Snapshot(placed, filters, buckets)


def _bucket(buckets: int) -> Column:
    return F.floor(F.conv(F.substring(F.md5("digest"), 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long")


def _key() -> Column:
    """Eight bytes of the digest for the filter, other than those that choose the bucket."""
    return F.unhex(F.substring(F.md5("digest"), 17, 16))


def _numbers(keys: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8")


def screen(groups: DataFrame, old: Snapshot) -> DataFrame:
    """``groups`` plus ``maybe``: false where the snapshot's filters rule the digest out."""
    incoming = groups.withColumn("bucket", _bucket(old.buckets)).withColumn("key", _key())

    def screened(batch: pa.Table, filters: pa.Table) -> pa.Table:
        found = np.zeros(len(batch), dtype=bool)
        if len(batch) and len(filters):
            found = fuse.contains(filters["filter"][0].as_py(), _numbers(batch["key"]))
        return pa.table({"digest": batch["digest"], "maybe": pa.array(found)})

    asked = incoming.select("digest", "bucket", "key").groupBy("bucket").cogroup(old.filters.groupBy("bucket"))
    return groups.join(asked.applyInArrow(screened, "digest string, maybe boolean"), "digest")


def digest_groups(keys: DataFrame) -> DataFrame:
    """``(digest, n, best)``: combined before the shuffle, so copies cost a row for each task."""
    return keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("order").alias("best"))


def merge(old: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups over a snapshot and the groups of a new batch."""
    asked = stored(screen(batch, old))
    before = old.groups.select("digest", F.col("n").alias("n0"), F.col("best").alias("b0"))
    hits = stored(
        asked.filter("maybe").join(before, "digest")
        .select("digest", (F.col("n") + F.col("n0")).alias("n"), F.greatest("best", "b0").alias("best"))
    )
    fresh = asked.drop("maybe").join(hits.select("digest"), "digest", "left_anti")
    rest = old.groups.select("digest", "n", "best").join(hits.select("digest"), "digest", "left_anti")
    return hits.unionByName(fresh).unionByName(rest)


def _keyed(texts: DataFrame) -> DataFrame:
    """Narrow rows of ``texts(id, text, digest)`` with the order in which rows of a group stay.

    The longest text stays, then the least id (null last); a row number tells repeated rows
    apart. Bitwise complements turn the order of integers round without overflow.
    """
    rows = texts.select(
        "id", "digest", F.sha2(normalised(F.col("text")), 256).alias("sha"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("size"),
        F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    order = F.struct(
        "size", F.col("id").isNotNull().alias("known"), F.bitwise_not("id").alias("low"), "key",
        F.bitwise_not("row").alias("early"), "id",
    )
    return rows.withColumn("order", order)


def collided(texts: DataFrame) -> DataFrame:
    """Digests of ``texts(text, digest)`` with more than one text behind them.

    The bytes are compared as the least and the greatest text of a digest, which are combined
    in each task before the shuffle.
    """
    norm = texts.select("digest", normalised(F.col("text")).alias("norm"))
    ends = norm.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return ends.filter("low != high").select("digest")


def duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 2, digest: Column | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, key.

    Texts are equal if they are after all white space is removed; a null text is an empty one.
    Of equal texts the one with the most code points stays, then the least id, null ids last;
    of repeated rows one. Rows come in ``batches`` by a hash of the id: the first becomes a
    snapshot, each later one is merged with it. An empty table gives an empty result.
    ``digest``, of a column ``text``, replaces the SHA-256 of the bytes; where texts collide,
    a digest of their own is made from the text itself.
    """
    texts = docs.select(F.col(plain(id)).alias("id"), F.col(plain(text)).alias("text"))
    return _grouped(texts.withColumn("digest", F.sha2(normalised(F.col("text")), 256) if digest is None else digest), batches)


def _grouped(texts: DataFrame, batches: int) -> DataFrame:
    """``duplicates`` of ``texts(id, text, digest)``; with digests of their own for texts that collide."""
    keys = stored(_keyed(texts))
    batch = F.pmod(F.xxhash64("id"), F.lit(batches))
    groups = stored(digest_groups(keys.filter(batch == 0)))
    for number in range(1, batches):
        new = stored(digest_groups(keys.filter(batch == number)))
        groups = stored(merge(snapshot(groups, new.count()), new))
    # Eight bytes find the texts; one too many does no harm.
    shared = stored(groups.filter("n > 1").select(F.xxhash64("digest").alias("short")))
    found = texts.withColumn("short", F.xxhash64("digest")).join(small(shared, MOST_BROADCAST), "short", "left_semi")
    clash = stored(collided(found))
    if not clash.isEmpty():
        own = F.sha2(normalised(F.col("text")), 512)
        apart = F.when(F.col("clash"), own).otherwise(F.col("digest"))
        marked = texts.join(small(clash, MOST_BROADCAST).withColumn("clash", F.lit(True)), "digest", "left")
        rest = marked.select("id", "text", apart.alias("digest"))
        return _grouped(rest, batches)
    return keys.join(groups, "digest").select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.bitwise_not("best.early")).alias("kept"), F.col("sha").alias("text_sha256"), "key",
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one.

    Rows are found again by id and a hash of the text, so ids need not be unique.
    """
    stays = duplicates(docs, id, text, batches).filter("kept").select(F.col("doc_id").alias("id"), "key")
    return found_again(docs, stays, id, text)
