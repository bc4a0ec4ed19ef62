"""Row-level helpers that keep costly expressions from being computed again and again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, entries: Column | str, name: str, place: str | None = None) -> DataFrame:
    """The other columns with one row per entry of an array, and its ``place`` if asked for.

    The plain ``explode`` makes the optimizer infer ``size(array) > 0`` and push it below
    joins and aggregates, where it computes the whole array expression once more, with
    inner texts repeated per lambda call. The outer form infers nothing, and the rows it
    adds for empty arrays are dropped by their missing place.
    """
    keep = [c for c in df.columns if c != entries]
    pos = place or "_place"
    rows = df.select(*keep, F.posexplode_outer(entries).alias(pos, name))
    rows = rows.filter(F.col(pos).isNotNull())
    return rows if place else rows.drop(pos)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column such that filters on it do not compute it a second time.

    The optimizer moves a filter below a projection by repeating the projected expression
    in it, once per mention; a JSON body would be parsed three or four times. It does not
    look into a generator, so the value is produced as a list of one.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.inline_outer(F.array(F.struct(value.alias(name)))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, for expressions that mention it often."""
    return F.get(F.transform(F.array(value), use), 0)
