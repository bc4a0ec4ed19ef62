"""The secret tagger: fixed patterns against plain code, decoding against all paths, held-out texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urlsight.llm import arrays, queries, secret_samples, secrets

BASE = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
               r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               lambda m: len(m.group(2)) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
}


def brute(text) -> list[tuple[str, int, int]]:
    found = [
        (m.start(), place, m.end(), kind)
        for place, (kind, (pattern, good)) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "") if good(m)
    ]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def texts_of(*values: bytes) -> arrays.Texts:
    return next(arrays.runs(pa.array(values, pa.binary()), 1 << 60))[2]


@pytest.fixture(scope="module")
def pieces(spark, sf_dir):
    return secrets.surroundings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@pytest.fixture(scope="module")
def field(pieces):
    return secrets.trained(pieces)


CRAFTED = [
    None, "", " \n", "plain words and no more", "é" * 40 + " Password : 'abcdefgh12' é token=short", "tOkEn = " + "a1" * 16,
    "token: secret: abcdefghij", 'api_key="AKIA' + "Z9" * 8 + '" APIKEY=12345678', "AKIA1234 AKIAAKIAABCDEFGHIJ AKIA" + "Q" * 11 + " AKIA" + "Q" * 12,
    "0123456789abcdef" * 3 + "G" + "f" * 31 + " " + "f" * 32, "password=" * 50, "secret" + " " * 5000 + "x", "Key toKİn = abcdefghijk",
    "passwd=abcdefgh\npasswd==..--//__++", "日本 token = " + "deadbeef" * 5 + " 語 ghp_" + "aB3dE5" * 6, "x " * 30000 + "token = " + "c0" * 20,
    "A" * 200000, "export DB_PASSWORD=hunter2!x\nAuthorization: Bearer " + "aB3dE5_x" * 5,
]


def test_fixed_patterns_and_columns(spark, tmp_path, field):
    rows = [(k, t, 1, 2, "s", 4) for k, t in enumerate(CRAFTED)] + [(3, CRAFTED[5], 1, 2, "s", 4)] * 2 + [(None, CRAFTED[4], 1, 2, "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings int, start int, `a.b c` string, __text int")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_secrets"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    expected = sorted((repr(id), brute(text)) for id, text, *_ in rows)
    shown = []
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [(kind, int(a), int(b)) for kind, a, b in spans if kind in BASE]
        starts = [(int(a), secrets.KINDS.index(kind)) for kind, a, _ in spans]
        assert starts == sorted(starts)
        assert [r[f"n_{kind}"] for kind in BASE] == [sum(b[0] == kind for b in base) for kind in BASE]
        joined = ",".join(":".join(map(str, b)) for b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        shown.append((repr(r["doc_id"]), base))
    assert sorted(shown) == expected


def test_an_operator_keeps_other_columns(spark, field):
    docs = spark.createDataFrame([(1, "a", "token = abcdefghij")], "findings int, `a.b` string, text string")
    out = secrets.scan(docs, field=field)
    assert out.columns == ["a.b", "findings"]
    assert out.first()["findings"][0].asDict() == {"kind": "assign", "start": 0, "end": 18}
    assert secrets.scan(docs.limit(0)).collect() == []


def scored(weights, follow, scores, tags):
    before, total = secrets.OUTSIDE, 0
    for row, tag in zip(scores, tags):
        total += row[tag] + follow[before][tag]
        before = tag
    return total


def test_decoding_finds_a_best_path():
    draw = np.random.default_rng(4)
    for turn in range(60):
        owner = np.sort(draw.integers(0, 4, 14)).astype(np.int32)
        follow = draw.integers(-30, 30, (3, 3)).astype(np.int32)
        scores = draw.integers(-40, 40, (14, 3)).astype(np.int32)
        scores[:, 0] += draw.integers(0, 120, 14, dtype=np.int32)  # many tokens surely outside
        field = secrets.Field(np.zeros((1, 3), np.int32), follow)
        tags = field.decode(scores, owner)
        for k in np.unique(owner):
            part = scores[owner == k]
            best = max(scored(None, follow, part, p) for p in itertools.product(range(3), repeat=len(part)))
            assert scored(None, follow, part, tags[owner == k]) == best


def test_chances_are_those_of_all_paths():
    draw = np.random.default_rng(5)
    owner = np.array([0, 0, 0, 1, 2, 2])
    follow, scores = draw.normal(size=(3, 3)), draw.normal(size=(6, 3))
    chances, moves, total = secrets.expected(scores, follow, owner)
    expected_total, expected_moves = 0.0, np.zeros((3, 3))
    for k in range(3):
        at = np.flatnonzero(owner == k)
        paths = list(itertools.product(range(3), repeat=len(at)))
        weight = np.array([np.exp(scored(None, follow, scores[at], p)) for p in paths])
        expected_total += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            for a, b in zip((0, *p), p):
                expected_moves[a, b] += w
        for place, token in enumerate(at):
            share = [sum(w for p, w in zip(paths, weight) if p[place] == t) / weight.sum() for t in range(3)]
            assert np.allclose(chances[token], share)
    assert np.isclose(total, expected_total) and np.allclose(moves, expected_moves)


def test_held_out_texts(field, pieces):
    held = secret_samples.generated(600, 99, pieces)
    texts = texts_of(*[t for t, _ in held])
    got = {(k, a - int(texts.bounds[k]), b - int(texts.bounds[k])) for k, a, b in field.spans(texts)}
    truth = {(k, a, b) for k, (_, spans) in enumerate(held) for a, b in spans}
    right = len(got & truth)
    assert right / len(got) > 0.93 and right / len(truth) > 0.93


def test_texts_of_the_corpus_are_left_alone(spark, sf_dir, field):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets.scan(docs, field=field).select("doc_id", F.explode("findings").alias("f"))
    assert found.filter("f.kind = 'secret'").select("doc_id").distinct().count() <= 0.005 * docs.count()


def test_features_do_not_hang_on_how_texts_are_cut(field, monkeypatch):
    draw = random.Random(2)
    samples = [t for t, _ in secret_samples.generated(40, 7)]
    texts = texts_of(*samples, b"", b"one", draw.randbytes(300))
    chain = secrets.Chain.of(texts)
    whole = field.emissions(texts.data, chain)
    monkeypatch.setattr(secrets, "TOKENS", 7)
    assert np.array_equal(field.emissions(texts.data, chain), whole)
    alone = [secrets.findings(texts_of(t), field)[0] for t in samples]
    assert secrets.findings(texts, field)[: len(samples)] == alone
