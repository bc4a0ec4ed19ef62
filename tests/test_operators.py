"""Ingest, corpus, features and models against brute force in Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from urlsight.operators import corpus, features, ingest, model, ranking, scoring


def labelled(spark, rows):
    return spark.createDataFrame(rows, "url string, label int")


def key(url, seed=42):
    return hashlib.md5(f"{url}:{seed}".encode()).hexdigest() + url


# ------------------------------------------------------------------ ingest


def test_first_seen_and_regroup(spark):
    rows = [(2, "r2", 0, "a"), (1, "r1", 0, "a"), (1, "r1", 1, "b"), (1, "r1", 2, "a"),
            (2, "r2", 1, "c"), (None, "r0", 0, "d"), (3, "r3", 0, "b")]
    df = spark.createDataFrame(rows, "id bigint, record string, pos int, domain string")
    fresh = ingest.first_seen(df, "domain", ["id", "record", "pos"])
    assert sorted((r.domain, r.id, r.pos) for r in fresh.collect() if r.id) == [
        ("a", 1, 0), ("b", 1, 1), ("c", 2, 1),
    ]
    packed = ingest.regroup(fresh, ["id", "record"])
    assert {r.record: r.urls for r in packed.collect()} == {
        "r0": ["d"], "r1": ["a", "b"], "r2": ["c"],
    }


def test_first_seen_combines_before_the_shuffle(spark):
    df = spark.range(1000).select(
        F.lit("hot").alias("domain"), "id", F.lit("r").alias("record"), F.lit(0).alias("pos")
    )
    fresh = ingest.first_seen(df, "domain", ["id", "record", "pos"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert [tuple(r) for r in fresh.collect()] == [("hot", 0, "r", 0)]


def test_records_without_an_id_stay_apart(spark):
    rows = [(None, "a.com", None), (None, "b.com", None), (None, "a.com", None)]
    df = spark.createDataFrame(rows, "id bigint, name_value string, common_name string")
    keys = df.select(ingest.record_key("id", "name_value", "common_name").alias("k"))
    assert keys.distinct().count() == 2


# ------------------------------------------------------------------ ranks


@pytest.mark.parametrize("few", [1, 50, 10_000])
def test_key_at_rank_equals_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW_KEYS", few)
    df = spark.range(3000).select(
        F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label")
    )
    wanted = [(0, 1), (0, 777), (0, 2000), (1, 1000), (1, 0)]
    found = ranking.key_at_rank(df, ranking.hash_key(42), "label", wanted)
    ordered = {g: sorted(key(f"u{i}") for i in range(3000) if (i % 3 == 0) == bool(g)) for g in (0, 1)}
    assert found == {(g, r): ordered[g][r - 1] for g, r in wanted if r}
    with pytest.raises(ValueError):
        ranking.key_at_rank(df, ranking.hash_key(42), "label", [(1, 1001)])


def test_repeated_rows_are_refused_at_the_cut(spark):
    df = labelled(spark, [("a", 0)] * 5 + [("b", 1)] * 5)
    with pytest.raises(ValueError, match="not distinct"):
        corpus.balance_split(df)


@pytest.mark.parametrize("bucket_rows", [10, 1_000_000])
def test_position(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket_rows)
    df = spark.range(500).select(F.concat(F.lit("u"), "id").alias("url"))
    got = {r.url: r.position for r in ranking.with_position(df, ranking.hash_key(7)).collect()}
    order = sorted((key(f"u{i}", 7), f"u{i}") for i in range(500))
    assert got == {url: place for place, (_, url) in enumerate(order, 1)}


@pytest.mark.parametrize("bounds", [[], [0.5], [0.01, 0.2, 0.200001, 0.7, 0.99], [-1.0, 2.0]])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, bounds, descending):
    values = [(g, round(v / 37, 6), v % 5, v % 3) for g in "ab" for v in range(38) if (v + len(g)) % 4]
    df = spark.createDataFrame(values, "g string, score double, pos bigint, neg bigint")
    got = ranking.running_totals(df, "score", ["pos", "neg"], ["g"], bounds, descending)
    result = {
        (r.g, r.score): (r.cum_pos, r.cum_neg, r.next_pos, r.next_neg) for r in got.collect()
    }
    expected = {}
    for g in "ab":
        rows = sorted([v for v in values if v[0] == g], key=lambda v: v[1], reverse=descending)
        pos = neg = 0
        for here, after in zip(rows, rows[1:] + [None]):
            pos, neg = pos + here[2], neg + here[3]
            expected[(g, here[1])] = (pos, neg, *(after[2:] if after else (None, None)))
    assert result == expected


def test_value_bounds(spark, monkeypatch):
    """The number of buckets follows the distinct values, however many rows each stands for."""
    df = spark.range(10_000).select((F.col("id") / 10_000).alias("score"))
    assert ranking.value_bounds(df, "score") == []
    monkeypatch.setattr(ranking, "BUCKET_VALUES", 100)
    bounds = ranking.value_bounds(df, "score")
    assert len(bounds) == 99 and bounds == sorted(bounds)
    assert all(abs(b - a - 0.01) < 0.002 for a, b in zip(bounds, bounds[1:]))
    with_none = df.unionByName(spark.createDataFrame([(float("-inf"),)], "score double"))
    assert float("-inf") not in ranking.value_bounds(with_none, "score")


# ------------------------------------------------------------------ corpus


def test_conflicting_labels_stay_benign(spark):
    df = corpus.union_corpus(labelled(spark, [("a", 0), ("b", 0)]), labelled(spark, [("a", 1), ("c", 1), ("c", 1)]))
    assert sorted(map(tuple, corpus.dedup_corpus(df).collect())) == [("a", 0), ("b", 0), ("c", 1)]
    assert tuple(corpus.dedup_report(df).first()) == (5, 3, 2)


@pytest.mark.parametrize("benign, malicious", [(100, 37), (10, 10), (3, 500), (5, 1), (4, 0)])
def test_balanced_split_sizes(spark, benign, malicious):
    rows = [(f"b{i}", 0) for i in range(benign)] + [(f"m{i}", 1) for i in range(malicious)]
    split = corpus.balance_split(labelled(spark, rows)).collect()
    size = min(benign, malicious)
    kept = int(size * 0.8)
    assert Counter((r.label, r.part) for r in split) == Counter({
        k: n for label in (0, 1)
        for k, n in {(label, "train"): kept, (label, "test"): size - kept}.items() if n
    })
    assert len({r.url for r in split}) == len(split)
    for label, name, total in ((0, "b", benign), (1, "m", malicious)):
        order = sorted((f"{name}{i}" for i in range(total)), key=key)
        assert {r.url for r in split if r.label == label and r.part == "train"} == set(order[:kept])


def test_split_plan_neither_sorts_nor_shuffles(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 2).cast("int").alias("label")
    )
    plan = corpus.balance_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.mark.parametrize("counts", [{0: 80, 1: 80}, {0: 101, 1: 7}, {0: 1, 1: 1}, {0: 33, 1: 34}])
def test_stratified_sizes(spark, counts):
    rows = [(f"{label}-{i}", label) for label, n in counts.items() for i in range(n)]
    split = corpus.stratified_split(labelled(spark, rows)).collect()
    total = sum(counts.values())
    assert sum(r.part == "validation" for r in split) == math.ceil(0.2 * total)
    for label, n in counts.items():
        kept = sum(r.part == "train" and r.label == label for r in split)
        assert abs(kept - n * (total - math.ceil(0.2 * total)) / total) < 1


def test_shuffle_repeats(spark):
    df = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"))
    rows = corpus.shuffle_corpus(df).collect()
    assert [r.position for r in rows] == list(range(1, 301))
    order = [r.url for r in rows]
    assert order == [r.url for r in corpus.shuffle_corpus(df.repartition(5)).collect()]
    assert order != sorted(order) and len(set(order)) == 300


def test_class_weights(spark):
    df = labelled(spark, [(str(i), int(i < 2)) for i in range(10)])
    assert {r.label: r.weight for r in corpus.class_weights(df).collect()} == {0: 10 / 16, 1: 10 / 4}


# ------------------------------------------------------------------ features


def test_vocabulary_and_vectors(spark):
    df = spark.createDataFrame([("http://Ab.b/c",), ("www.b-C?é",)], "url string")
    vocab = features.char_vocab(df)
    # b three times, c twice, then the higher character first
    assert [(r.id, r.token, r.n) for r in vocab.orderBy("id").collect()] == [
        (2, "b", 3), (3, "c", 2), (4, "é", 1), (5, "a", 1),
    ]
    probe = spark.createDataFrame([("a.zb",), ("",), ("a" * 300,)], "url string")
    ids = {r.url: r.ids for r in features.vectorize(probe, vocab).collect()}
    assert ids["a.zb"] == [5, 1, 2] + [0] * 197
    assert ids[""] == [0] * 200
    assert ids["a" * 300] == [5] * 200
    kept = features.char_vocab(df, strip_punct=False)
    assert {r.token for r in kept.collect()} >= {".", "/", "-", "?"}


def test_vocabulary_keeps_the_most_frequent(spark):
    df = spark.range(1).select(F.lit("aaabbcccdd").alias("url"))
    assert [r.token for r in features.char_vocab(df, size=4).orderBy("id").collect()] == ["c", "a"]


def test_grams(spark):
    texts = ["", "ab", "abc", "abcabc", "äöü😀x", "a" * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.g for r in df.select("t", features.char_grams(F.col("t")).alias("g")).collect()}
    for t in texts:
        expected = [t[i:i + w] for w in (3, 5, 7) for i in range(len(t) - w + 1)]
        assert sorted(got[t]) == sorted(set(expected))


# ------------------------------------------------------------------ models


ROWS = [("http://good.org/abc", 0), ("http://good.org/abd", 0), ("http://fine.net/x", 0),
        ("http://evil.biz/login", 1), ("http://evil.biz/logon", 1), ("https://bad.biz/log", 1)]


def nb(rows):
    """Log-odds of 3-grams, written out."""
    def grams(url):
        t = "".join(c for c in url.split("://")[1] if c.isalnum())
        return {t[i:i + 3] for i in range(len(t) - 2)}

    size = Counter(label for _, label in rows)
    pos = Counter(g for u, label in rows if label for g in grams(u))
    neg = Counter(g for u, label in rows if not label for g in grams(u))
    table = {
        g: math.log(((pos[g] + 1) / (size[1] + 2)) / ((neg[g] + 1) / (size[0] + 2)))
        for g in pos | neg
    }
    return table, lambda url: 1 / (1 + math.exp(-sum(table.get(g, 0) for g in grams(url))))


@pytest.mark.parametrize("broadcast_rows", [200_000, 10, 1])
def test_table_model(spark, broadcast_rows):
    expected, score = nb(ROWS)
    table = model.train_table(labelled(spark, ROWS))
    assert {r.gram: r.log_odds for r in table.collect()} == pytest.approx(expected)
    urls = [u for u, _ in ROWS] + ["http://evil.biz/login"] * 50 + ["zz", "http://new.biz/login"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = scoring.score_with_table(df, scoring.table_model(table, broadcast_rows=broadcast_rows))
    assert {r.i: r.raw for r in got.collect()} == pytest.approx(
        {i: score(u) if "://" in u else 0.5 for i, u in enumerate(urls)}
    )


def test_a_small_table_scores_each_row_by_itself(spark):
    loaded = scoring.table_model(model.train_table(labelled(spark, ROWS)))
    scored = scoring.score_urls(spark.range(5).select(F.concat(F.lit("evil"), "id").alias("url")), loaded)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    empty = spark.createDataFrame([(None,), ("",)], "url string")
    assert [r.raw for r in scoring.score_with_table(empty, loaded).collect()] == [0.5, 0.5]


def test_scores_are_labelled_before_rounding(spark):
    df = spark.createDataFrame([("a", 0.503), ("b", 0.5), ("c", 0.126)], "url string, raw double")
    assert sorted((r.url, r.classification, r.score) for r in scoring.classify(df).collect()) == [
        ("a", "MALICIOUS", 0.5), ("b", "BENIGN", 0.5), ("c", "BENIGN", 0.13),
    ]


def test_score_urls_has_the_shape_of_the_table(spark):
    table = model.train_table(labelled(spark, ROWS))
    scored = scoring.score_urls(spark.createDataFrame([("evil.biz",)], "url string"), table)
    assert scored.columns == ["url", "score", "classification", "time_added"]
    assert dict(scored.dtypes)["time_added"] == "timestamp"


def test_batch_scorer_gets_spaced_normal_forms(spark):
    def load():
        return lambda texts: [len(t.split(" ")) / 100 for t in texts]

    df = spark.createDataFrame([("https://www.abc",), ("x" * 60,)], "url string")
    scored = scoring.score_urls(df, scoring.batch_scorer(load)).collect()
    assert {r.url[:5]: (r.score, r.classification) for r in scored} == {
        "https": (0.03, "BENIGN"), "xxxxx": (0.6, "MALICIOUS"),
    }


@pytest.fixture(scope="module")
def corpus_rows(spark):
    rows = [(f"http://site{i % 17}.org/page/{i}", 0) for i in range(120)]
    rows += [(f"http://evil{i % 5}.biz/login?x={i}", 1) for i in range(60)]
    return labelled(spark, rows)


def test_regression_learns_and_survives_saving(spark, corpus_rows, tmp_path):
    fitted = model.train(corpus_rows, max_iter=5, features=1 << 12)
    before = model.predict(corpus_rows, fitted)
    model.save_model(fitted, str(tmp_path / "model"))
    after = model.predict(corpus_rows, model.load_model(str(tmp_path / "model")))
    assert {r.url: r.raw for r in before.collect()} == {r.url: r.raw for r in after.collect()}
    assert before.filter((F.col("raw") > 0.5).cast("int") == F.col("label")).count() == 180
    scored = scoring.score_urls(corpus_rows, fitted)
    assert scored.filter(F.col("classification") == "MALICIOUS").count() == 60


def test_features_mark_presence(spark, corpus_rows):
    fitted = model.train(corpus_rows, max_iter=1, features=1 << 12)
    prepared = features.with_grams(spark.createDataFrame([("aaaaaaa",)], "url string"))
    row = fitted.stages[0].transform(prepared).select(vector_to_array("features").alias("f")).first()
    assert set(row.f) == {0.0, 1.0}


def test_selection_keeps_the_best_round(spark, corpus_rows):
    parts = corpus.stratified_split(corpus_rows)
    chosen = model.select_model(
        parts.filter("part = 'train'").drop("part"), parts.filter("part = 'validation'").drop("part"),
        max_rounds=3, max_iter=3, features=1 << 10, widths=(3,),
    )
    losses = [loss for _, _, loss, _ in chosen.history]
    assert [number for number, *_ in chosen.history] == [1, 2, 3]
    held_out = model.predict(parts.filter("part = 'validation'"), chosen.by_loss, widths=(3,))
    loss, _ = model.validation_scores(held_out)
    assert loss == pytest.approx(min(losses))
    assert np.isfinite(losses).all()


def test_selection_stops_when_nothing_gets_better(spark, corpus_rows, monkeypatch):
    steps = iter([(0.5, 0.6), (0.6, 0.7), (0.7, 0.6), (0.8, 0.6), (0.1, 0.9)])
    monkeypatch.setattr(model, "validation_scores", lambda *a, **k: next(steps))
    chosen = model.select_model(
        corpus_rows, corpus_rows, start_reg=1.0, step=16.0, max_iter=1, features=1 << 8, widths=(3,)
    )
    assert [loss for _, _, loss, _ in chosen.history] == [0.5, 0.6, 0.7, 0.8]
    regs = [reg for _, reg, _, _ in chosen.history]
    assert regs == pytest.approx([1, 1 / 16, 1 / 256, 1 / 1024])
