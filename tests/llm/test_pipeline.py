"""Every stage of the pipeline, and all of them, against plain code on a table of edge cases."""

import subprocess
import sys
from collections import Counter

import brute
import duckdb
import pytest
from conftest import ROOT
from pyspark.sql import functions as F
from test_contracts import check_sequences, crafted

import corpus_pipeline
from urlsight.llm import queries
from urlsight.llm.oracles import WEIGHTED_MIX

STAGES = dict(corpus_pipeline.STAGES)
#: Names that stages use themselves, or that look like theirs.
CLASHING = ("kept", "n_words", "__id", "__key", "__times", "id", "key", "row", "times", "print", "__text", "a.b c", "size")


def last(id):
    return (id is None, 0 if id is None else id)


@pytest.fixture(scope="module")
def rows():
    made = [r for r in crafted() if r[0] is not None]
    # Near copies within two bits, planted as copies with one letter case or one word of very many changed.
    long = " ".join(f"w{k}" for k in range(4000))
    made += [(500, long, "s1"), (499, long.replace("w2000 ", "other "), "s2"), (501, long.upper(), "s1"), (502, long + " w0", "Z")]
    return [(id, t, s) for (id, t), s in {(id, t): s for id, t, s in made}.items()]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for k, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(-k))
    df.repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def kept_by(rows, stage):
    """What plain code keeps, as a count of rows."""
    if stage == "quality":
        return Counter(r for r in rows if brute.good(r[1]))
    if stage == "exact_dedup":
        groups = {}
        for row in rows:
            groups.setdefault("".join((row[1] or "").split()) if row[1] else "", []).append(row)
        # Only the six white space characters count; none of the others is in these rows' copies.
        return Counter(min(g, key=lambda r: (-len(r[1] or ""), last(r[0]))) for g in groups.values())
    classes = {(doc, text): component for (doc, text, _), (_, _, component) in zip(rows, brute.near_duplicates(rows))}
    return Counter(r for r in rows if classes[r[:2]] == r[0])


def plain(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark, folder):
    """What each stage gets and gives, run one after another."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (given, docs)
    return out


@pytest.mark.parametrize("name", ["quality", "exact_dedup", "near_dedup"])
def test_a_stage_keeps_what_plain_code_keeps(made, name):
    given, kept = made[name]
    assert kept.columns == given.columns and kept.schema.simpleString() == given.schema.simpleString()
    before = [(r["doc_id"], r["text"], r["source"]) for r in given.collect()]
    assert plain(kept) == kept_by(before, name)
    assert 0 < kept.count() < given.count()
    for k, column in enumerate(CLASHING):
        assert kept.filter(F.col(f"`{column}`") != -k).count() == 0


def test_the_mix_takes_what_sql_takes(made, folder):
    given, mixed = made["mixing"]
    assert mixed.columns == given.columns
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, text, source from '{folder}/near_dedup/*.parquet'")
    taken = {doc: (size, total) for doc, size, _, _, total in con.execute(WEIGHTED_MIX).fetchall()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(taken)
    assert all(times[doc] * size == total for doc, (size, total) in taken.items())


def test_the_last_stage_packs_every_document(made):
    given, packed = made["packing"]
    got = packed.collect()
    check_sequences(got, 2048)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in given.collect()]
    expected = Counter((d, p, s, n) for d, p, s, n, _ in brute.pieces(rows, queries.tokenizer_path()))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == expected


def test_the_whole_pipeline_is_its_stages(spark, folder, made):
    whole = corpus_pipeline.run(spark, folder)
    shown = ["doc_id", "piece", "start", "length"]
    assert Counter(map(tuple, whole.select(*shown).collect())) == Counter(map(tuple, made["packing"][1].select(*shown).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_an_empty_table_and_null_ids(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert STAGES[name](spark, docs.limit(0), folder).collect() == []
    nameless = docs.filter("doc_id between 5 and 9").withColumn("doc_id", F.lit(None).cast("long"))
    repeated = STAGES[name](spark, nameless.unionByName(nameless), folder).collect()
    assert all(r["doc_id"] is None for r in repeated)
    if name in ("exact_dedup", "near_dedup"):
        assert len(repeated) == nameless.select("text").distinct().count() - 1


def test_workers_do_not_need_the_package(sf_dir, tmp_path):
    """From another folder the workers cannot import the package, as on a cluster."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from urlsight.session import build_session
spark = build_session(master="local[8]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
for name, query in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, {sf_dir!r}).collect()
        print("done", name, flush=True)
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("done") == len(queries.QUERIES) + 1
