"""Which names are worth scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark certificate metadata rather than a domain.
METADATA_PHRASES = (
    "terms of use", "see www.", "(c)", "http://", "https://", "go to", "repository",
    "resources/cps", "incits", "copyright", "visit", "refer to",
)

# The top-level domains whose certificates are watched.
MONITORED_TLDS = ("com", "net", "org", "io", "dev", "app", "co", "ai", "xyz")


def is_wildcard(name: Column) -> Column:
    return name.startswith("*.")


def is_valid_domain(name: Column) -> Column:
    """A real domain: dotted, no blank, no wildcard, no metadata phrase. NULL is none."""
    lowered = F.lower(name)
    metadata = reduce(lambda a, b: a | b, [lowered.contains(p) for p in METADATA_PHRASES])
    valid = name.contains(".") & ~name.contains(" ") & ~is_wildcard(name) & ~metadata
    return F.coalesce(valid, F.lit(False))


def has_monitored_tld(name: Column) -> Column:
    """The name ends in a dot and one of the watched top-level domains."""
    last = F.substring_index(F.lower(name), ".", -1)
    return F.coalesce(name.contains(".") & last.isin(*MONITORED_TLDS), F.lit(False))


def valid_names(names: Column) -> Column:
    """The valid domains of an array, order and repeats kept."""
    return F.filter(names, is_valid_domain)
