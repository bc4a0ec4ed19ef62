"""Every query of the subpackage against plain code, on a table full of edge cases."""

import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from urlsight.llm import exact_dedup, mixing, packing, pii, quality, queries, sharding, simhash
from urlsight.llm.stored import stored

CLASHING = ("size", "shard", "slot", "key", "block", "print", "fingerprint", "findings", "kept", "n_words", "digest",
            "row", "place", "target", "length", "sequence_id", "offset", "score", "hits", "text_sha256", "a.b c")


def crafted() -> list[tuple]:
    """Rows (doc_id, text, source): nulls, ties, repeats, copies, shared passages, odd white space."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(draw.choices(vocabulary, k=n))

    base, passage = prose(300), prose(60)
    near = base.split(" ")
    near[150] = "changed"
    texts = [
        None, "", "  \n\t ", "word", "two words", base, base, "  " + base.replace(" ", "\n", 40), " ".join(near),
        prose(120) + " " + passage + " " + prose(80), passage + " " + prose(200), prose(90) + "\n" + passage,
        prose(31) + " " + base + " " + prose(10), prose(3000), "a" * 3000, "ab " * 900, "é" * 700, "日本語 テキスト " * 80,
        "x  y   z\n  w\t\tv  u t  " * 60, "<|endoftext|> inside <|endoftext|>", "🙂 emoji 👩‍👩‍👧 text " * 50,
        "line one\nline one\n\n \nline two\nline one", "# * $ % & | < >", "it's we'll they're  'quoted' 's", prose(5000),
        "Mail a.b+c@ex-ample.co.uk or x@y, q@w.e@r.t.z; 1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.1 +44 (20) 7946-0958 +1+2 3",
        "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500005555555559 iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789",
        "GNU  General\nPublic, License v3; Apache License 2.0. CC BY 4.0 and cc-by cc by. MIT License MIT license",
        "SPDX-License-Identifier: Apache-2.0\nLicensed under the MIT license. gnu general public", prose(49), prose(50),
        # Repeats that only the method's own rules find too long: in all 30 and 45 of a text's words.
        f"{prose(60)} {passage[: 200]} {prose(40)} {passage[: 200]}", f"{prose(90)} {base[: 260]} {prose(50)} {base[: 260]}",
        " leading and trailing ", "\x0b\x0cpage\x1cbreak\x85", "same tail " + base[-400:], "other " + base[-400:],
    ]
    rows = [(k, t, f"s{k % 4}") for k, t in enumerate(texts)]
    rows += [(None, base, None), (None, prose(70), "s1"), (7, "the same id, another text", "s2"), (3, "word", "s3"),
             (3, "word", "s3"), (100, prose(400), "Z"), (101, "", "a"), (-5, base, "é"), (-6, " ".join(near[:200]), None)]
    return rows


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40)
    return crafted() + [(1000 + r["doc_id"], r["text"], r["source"]) for r in real.collect()]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """The rows as documents, with more columns whose names clash; and an empty table."""
    made = {}
    for name, data in (("full", rows), ("empty", [])):
        folder = tmp_path_factory.mktemp(name)
        df = spark.createDataFrame(data, "doc_id long, text string, source string")
        for k, column in enumerate(CLASHING):
            df = df.withColumn(column, F.lit(k))
        df.repartition(5).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        made[name] = str(folder)
    return made


def run(spark, tables, name, which="full"):
    return queries.QUERIES[name](spark, tables[which]).collect()


def same(got, expected):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, expected), key=repr)


# The operator on vectors reads another table; see test_hard_negatives.
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op13_hard_negatives"}))
def test_an_empty_table_gives_an_empty_result(spark, tables, name):
    assert run(spark, tables, name, "empty") == []


def test_simhash(spark, tables, rows):
    got = run(spark, tables, "op1_simhash")
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], brute.near_duplicates(rows))


def test_packing(spark, tables, rows):
    got = run(spark, tables, "op2_best_fit_packing")
    path = queries.tokenizer_path()
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], brute.pieces(rows, path))
    check_sequences(got, 2048)


def check_sequences(got, capacity):
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(sequences) <= 1.02 * total / capacity + 2


def test_personal_data(spark, tables, rows):
    got = run(spark, tables, "op3_pii")
    expected = []
    for doc, text, _ in rows:
        counts, digest, listed = brute.personal_data(text)
        expected.append((doc, *counts, digest))
    same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got], expected)
    assert any("iban:" in r["spans"] for r in got) and any("ssn:" in r["spans"] for r in got)


def test_repeated_bytes(spark, tables, rows):
    got = run(spark, tables, "op4_suffix_dedup")
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got],
         brute.repeated_bytes(rows))


def test_exact_duplicates(spark, tables, rows):
    got = run(spark, tables, "op5_exact_dedup")
    expected, groups = brute.exact_duplicates(rows)
    same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], expected)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert len(kept) == groups and set(kept.values()) == {1}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_license_base(spark, tables, rows):
    got = run(spark, tables, "op6_license_scan")
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got],
         [(doc, *brute.license_base(t)) for doc, t, _ in rows])
    for r in got:
        assert set(r["base_labels"].split(",")) <= {"", *r["labels"].split(",")}
        assert 0 <= r["score"] <= 1


def test_shards(spark, tables, rows):
    import zlib

    got = run(spark, tables, "op7_sampled_shards")
    sizes = [(doc, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for doc, t, _ in rows]
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], sizes)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    total, largest = sum(s for _, s, _ in sizes), max(s for _, s, _ in sizes)
    assert set(shards) <= set(range(16))
    for k in range(16):
        assert abs(sum(r["size"] for r in shards[k]) - total / 16) <= largest


def test_quality(spark, tables, rows):
    got = run(spark, tables, "op8_quality_rules")
    names = [*quality.MEASURES, "base_failed"]
    same([(r["doc_id"], *[r[n] for n in names]) for r in got], [(doc, *brute.quality(t)) for doc, t, _ in rows])
    same([(r["doc_id"], r["kept"]) for r in got], [(doc, brute.good(t)) for doc, t, _ in rows])
    assert any(not r["kept"] and not r["base_failed"] for r in got)


def test_repeated_words(spark, tables, rows):
    got = run(spark, tables, "op9_block_dedup")
    same([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], brute.repeated_words(rows))


def test_mixing(spark, tables, rows):
    got = run(spark, tables, "op10_weighted_mix")
    sizes = [(doc, len(brute.WORD.findall(t or ""))) for doc, t, _ in rows]
    same([(r["doc_id"], r["size"]) for r in got], sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, run(spark, tables, "op10_weighted_mix")), key=repr)
    total = defaultdict(int)
    for (_, t, source) in rows:
        total[source] += len(brute.WORD.findall(t or ""))
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, budget, free = {}, float(sum(total.values())), set(order)
    while True:
        share = {s: budget * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s], budget = 3.0 * total[s], budget - 3 * total[s]
        free -= over
    target |= share
    found, taken, largest = defaultdict(set), defaultdict(int), max(s for _, s in sizes)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        found[r["source_size"]].add(round(r["target"], 6))
        taken[r["source_size"]] += r["taken"]
    for s in order:
        assert round(target[s], 6) in found[total[s]]
    by_size = defaultdict(float)
    for s in order:
        by_size[total[s]] += target[s]
    for size, wanted in by_size.items():
        assert abs(taken[size] - wanted) <= largest
    assert sum(taken.values()) <= sum(total.values())


def test_all_columns_come_back(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    for made in (exact_dedup.keep_one(docs), simhash.keep_one(docs), mixing.mix(docs)):
        assert made.columns == docs.columns
        assert made.schema.simpleString() == docs.schema.simpleString()
    assert exact_dedup.keep_one(docs).count() == brute.exact_duplicates(
        [(r["doc_id"], r["text"], None) for r in docs.collect()])[1]
    assert set(docs.columns) - {"kept", "n_words"} <= set(quality.measure(docs).columns)
    assert set(docs.columns) - {"text"} <= set(pii.scan(docs).columns)


def test_mixed_rows_are_those_taken(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    times = Counter()
    for r in mixing.takes(docs).collect():
        times[r["doc_id"], r["key"]] += r["times"]
    key = F.xxhash64("text").alias("key")
    got = Counter((r["doc_id"], r["key"]) for r in mixing.mix(docs).select("doc_id", key).collect())
    assert got == +times


def test_pieces_carry_ids_and_columns(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    made = stored(packing.pieces(docs, queries.tokenizer_path(), keep=("source",), capacity=64))
    got = packing.pack(made, capacity=64, group=50).collect()
    assert all(len(r["ids"]) == r["length"] <= 64 for r in got)
    check_sequences(got, 64)


def test_sequences_are_assembled_from_their_pieces(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet").filter("doc_id < 10")
    made = stored(packing.pieces(docs, queries.tokenizer_path(), capacity=128))
    packed = stored(packing.pack(made, capacity=128))
    whole = {r["sequence_id"]: r["ids"] for r in packing.assemble(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"]: r["offset"] + r["length"]] == r["ids"]


def test_shards_are_written(spark, tables, rows, tmp_path):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(rows) and {r["shard"] for r in back.select("shard").collect()} == {0, 1, 2, 3}


def test_shards_with_a_hot_text(spark):
    """Half of the rows have one text; they are cut where the balance wants it."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "hot " * 50).otherwise(F.repeat(F.col("id").cast("string"), 20)).alias("text"),
    )
    sizes = [r["bytes"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 201
