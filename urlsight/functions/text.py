"""URL and certificate-name expressions. Every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from urlsight.functions.rows import let

# What is removed from a URL before scoring, and what a host is.
SCHEME_OR_WWW = r"https?://|www\."
HOST = r"(?:https?://)?(?:www\.)?([^/]+)"

# The punctuation a default text vectoriser strips.
PUNCTUATION = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~']"""

# The white space Python's str.strip removes: Unicode White_Space and the four separators.
_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Cut white space off both ends, as Python's ``str.strip`` does."""
    return F.regexp_replace(text, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def drop_invalid_utf8(text: Column) -> Column:
    """Remove the bytes that are not UTF-8 and keep everything else.

    ``make_valid_utf8`` writes U+FFFD for each bad sequence. A genuine U+FFFD in the
    same line is parked on a noncharacter meanwhile, so it is not removed with them.
    """
    parked = F.replace(text, F.lit("\ufffd"), F.lit("\ufdd0"))
    repaired = F.replace(F.make_valid_utf8(parked), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(repaired, F.lit("\ufdd0"), F.lit("\ufffd"))
    )


def normalize_url(url: Column, max_len: int = 500) -> Column:
    """Lower-case, drop every scheme and ``www.`` wherever it stands, keep ``max_len``."""
    return F.substring(F.regexp_replace(F.lower(url), SCHEME_OR_WWW, ""), 1, max_len)


def characters(text: Column) -> Column:
    """The characters of a text as an array; the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def spaced_characters(text: Column) -> Column:
    """Characters joined by blanks."""
    return F.concat_ws(" ", characters(text))


def model_text(normalized: Column, strip_punct: bool = True) -> Column:
    """The characters that reach the model: no white space and, by default, no punctuation."""
    pattern = rf"(?U)\s+|{PUNCTUATION}" if strip_punct else r"(?U)\s+"
    return F.regexp_replace(normalized, pattern, "")


def extract_domain(url: Column) -> Column:
    """Host part of a URL; NULL where there is none."""
    return F.nullif(F.regexp_extract(url, HOST, 1), F.lit(""))


def has_domain(url: Column) -> Column:
    """Whether ``extract_domain`` finds one: any character but a slash will do.

    Cheaper in a filter than testing the extracted domain, which would run the pattern
    twice per row.
    """
    return F.btrim(url, F.lit("/")) != ""


def url_prefix(url: Column, length: int = 80) -> Column:
    """Display form of a URL."""
    return F.substring(url, 1, length)


def domain_prefix(domain: Column, length: int = 50) -> Column:
    """Display form of a domain."""
    return F.substring(domain, 1, length)


def certificate_names(name_value: Column, common_name: Column) -> Column:
    """Names of one certificate: stripped lines, then the common name if not among them.

    Duplicates within the lines stay; removing repeats is the job of ``first_seen``.
    """
    lines = F.transform(F.split(F.coalesce(name_value, F.lit("")), "\n"), strip)
    names = F.filter(lines, lambda name: name != "")
    named = F.coalesce(common_name, F.lit("")) != ""

    def with_common(listed: Column) -> Column:
        extra = named & ~F.array_contains(listed, common_name)
        return F.when(extra, F.array_append(listed, common_name)).otherwise(listed)

    return let(names, with_common)


def iso_timestamp(moment: Column) -> Column:
    """ISO text of a UTC timestamp; microseconds only where there are any."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(whole, fraction, F.lit("+00:00"))


def iso_columns(df: DataFrame) -> DataFrame:
    """Timestamps and dates of a result as the ISO texts the dashboard is served."""
    shown = []
    for field in df.schema:
        value = F.col(field.name)
        if isinstance(field.dataType, TimestampType):
            value = iso_timestamp(value)
        elif isinstance(field.dataType, DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        shown.append(value.alias(field.name))
    return df.select(*shown)
