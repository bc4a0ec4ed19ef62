"""Expressions on edge values; the expected values follow Python's own string rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urlsight.functions import predicates, score, text

URLS = [
    ("https://www.a.com/x", "a.com", "a.com/x"),
    ("http://a.com:80?x=1", "a.com:80?x=1", "a.com:80?x=1"),
    ("https://", "https:", ""),
    ("///", None, "///"),
    ("www.", "www.", ""),
    ("wwwx.com/", "wwwx.com", "wwwx.com/"),
    ("https://www.", "www.", ""),
    ("HTTPS://www.A.com/x", "HTTPS:", "a.com/x"),
    ("a.com", "a.com", "a.com"),
    ("", None, ""),
    ("www.www.a.com", "www.a.com", "a.com"),
    ("http://u@www.b.com/", "u@www.b.com", "u@b.com/"),
    ("ΑΣ.com/İK", "ΑΣ.com", "ασ.com/i\u0307k"),
]


def column(spark, values, expression, kind="string"):
    """The expression over one column ``v``, results in input order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["r"] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_domain_and_normal_form(spark):
    urls = [u for u, _, _ in URLS]
    assert column(spark, urls, text.extract_domain) == [d for _, d, _ in URLS]
    assert column(spark, urls, text.has_domain) == [d is not None for _, d, _ in URLS]
    assert column(spark, urls, text.normalize_url) == [n for _, _, n in URLS]


def test_null_url(spark):
    assert column(spark, [None], text.extract_domain) == [None]
    assert column(spark, [None], text.normalize_url) == [None]


def test_normal_form_is_cut_after_stripping(spark):
    long = "https://www." + "a" * 600
    assert column(spark, [long], text.normalize_url) == ["a" * 500]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="htps:/w.AbÄ ü-?=😀", max_size=40), min_size=50, max_size=50))
def test_normal_form_equals_python(spark, urls):
    expected = [re.sub(r"https?://|www\.", "", u.lower())[:500] for u in urls]
    assert column(spark, urls, text.normalize_url) == expected
    assert column(spark, urls, lambda c: text.spaced_characters(text.normalize_url(c))) == [
        " ".join(e) for e in expected
    ]


SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0      　​"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=SPACES + "ab", max_size=12), min_size=80, max_size=80))
def test_strip_equals_python(spark, values):
    assert column(spark, values, text.strip) == [v.strip() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.binary(max_size=12), min_size=80, max_size=80))
def test_invalid_bytes_are_dropped_as_in_python(spark, values):
    values += [b"\xef\xbf\xbd\xff", b"\xff\xfeb.com", b"\xc2\xa0c.com", b"\xf0\x9f\x98\x80\xf0\x9f"]
    data = [bytearray(v) for v in values]
    got = column(spark, data, lambda c: text.drop_invalid_utf8(c.cast("string")), "binary")
    assert got == [v.decode("utf-8", errors="ignore") for v in values]


@pytest.mark.parametrize(
    "names, common, expected",
    [
        ("a.com\n b.com \n\n", "c.com", ["a.com", "b.com", "c.com"]),
        ("a.com\na.com", "a.com", ["a.com", "a.com"]),
        (None, "a.com", ["a.com"]),
        ("", None, []),
        ("a.com", "", ["a.com"]),
        ("a.com", " a.com", ["a.com", " a.com"]),
    ],
)
def test_certificate_names(spark, names, common, expected):
    df = spark.createDataFrame([(names, common)], "n string, c string")
    assert df.select(text.certificate_names(F.col("n"), F.col("c"))).first()[0] == expected


def test_valid_domains(spark):
    bad = [
        None, "", "*.a.com", "nodot", "a b.com", "http://a.com", "See www.x.com", "Visit a.com",
        "(c) a.com", "repository.a.com", "x.com/resources/cps", "INCITS.org", "Copyright.com",
    ]
    good = ["a.com", "xn--a.com", "a.b", "."]
    assert column(spark, bad, predicates.is_valid_domain) == [False] * len(bad)
    assert column(spark, good, predicates.is_valid_domain) == [True] * len(good)


def test_monitored_tld(spark):
    names = ["a.com", "a.COM", "com", "a.com.ru", "a.xyz", "a.", None]
    assert column(spark, names, predicates.has_monitored_tld) == [
        True, True, False, False, True, False, False,
    ]


def test_label_before_rounding(spark):
    scores = [0.5, 0.503, 0.125, 0.375, 0.625, 0.875, 1.0, 0.0]
    labels = column(spark, scores, score.label_score, "double")
    rounded = column(spark, scores, score.round_score, "double")
    assert labels[:2] == ["BENIGN", "MALICIOUS"]
    assert rounded == [0.5, 0.5, 0.12, 0.38, 0.62, 0.88, 1.0, 0.0]


def test_rounding_equals_python_on_floats(spark):
    import numpy as np

    values = [float(v) for v in np.linspace(0, 1, 5001).astype("float32")]
    assert column(spark, values, score.round_score, "double") == [round(v, 2) for v in values]


def test_bands(spark):
    values = [0.1, 0.3, 0.5, 0.7, 0.9, 0.09, None]
    assert column(spark, values, score.score_band, "double") == [
        "0.1-0.3", "0.3-0.5", "0.5-0.7", "0.7-0.9", "0.9-1.0", "0.0-0.1", "0.0-0.1",
    ]
    urls = ["x" * n for n in (29, 30, 49, 50, 74, 75, 99, 100)] + [None]
    assert column(spark, urls, score.length_band) == [
        "0-30", "30-50", "30-50", "50-75", "50-75", "75-100", "75-100", "100+", "100+",
    ]
    assert column(spark, ["MALICIOUS", "BENIGN", "other", None], score.is_malicious) == [1, 0, 0, 0]


def test_iso_timestamps(spark):
    df = spark.sql(
        "select timestamp '2024-01-02 03:04:05' a, timestamp '2024-01-02 03:04:05.12' b, "
        "date '2024-01-02' c, cast(null as timestamp) d"
    )
    assert tuple(text.iso_columns(df).first()) == (
        "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.120000+00:00", "2024-01-02", None,
    )
