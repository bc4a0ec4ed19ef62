"""Every registered query against its SQL on the same tables."""

import subprocess
import sys

import compare
import pytest
from conftest import ROOT

import __spark_entry__ as entry_module

SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_returns_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["domain", "count", "avg_confidence"]
    assert df.count() > 0


def test_python_workers_do_not_need_the_package(sf_dir, tmp_path):
    """From another folder the workers cannot import the package, as on a cluster."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from urlsight.session import build_session
spark = build_session(master="local[4]", **{{"spark.ui.enabled": "false"}})
for name in ("stream_ingest", "score_user_model"):
    assert e.queries()[name](spark, {sf_dir!r}).count() > 0
"""
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, timeout=300)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    columns, rows = compare.spark_rows(QUERIES[name](spark, sf_dir))
    assert rows
    if name in SQL:
        expected_columns, expected = compare.sql_rows(con, SQL[name])
        assert columns == expected_columns
        assert rows == expected
