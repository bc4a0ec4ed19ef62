"""Rows handed in by users: a request is a JSON list and is taken whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsight.functions.rows import computed_once, unnest
from urlsight.schemas import CLASSIFIED
from urlsight.sinks.table import write_classified
from urlsight.sources.messages import good_rows

_ROWS = "array<map<string,string>>"


def _fits(row: Column) -> Column:
    """No unknown field, and every given value can be read as its column's type."""
    known = F.array(*[F.lit(f.name) for f in CLASSIFIED])
    tests = [F.size(F.array_except(F.map_keys(row), known)) == 0]
    for field in CLASSIFIED:
        value = F.try_element_at(row, F.lit(field.name))
        tests.append(value.isNull() | value.try_cast(field.dataType).isNotNull())
    fits = tests[0]
    for test in tests[1:]:
        fits = fits & test
    return row.isNotNull() & fits


def parse_submissions(df: DataFrame, body: str = "value") -> DataFrame:
    """Requests with their typed ``rows``, or an ``error`` if any row is invalid."""
    parsed = computed_once(df, "_rows", F.from_json(F.col(body), _ROWS))
    error = (
        F.when(F.col("_rows").isNull(), F.lit("not a JSON list of objects"))
        .when(~F.forall("_rows", _fits), F.lit("invalid row"))
    )

    def typed(row: Column) -> Column:
        return F.struct(*[
            F.try_element_at(row, F.lit(f.name)).try_cast(f.dataType).alias(f.name)
            for f in CLASSIFIED
        ])

    return (
        parsed.withColumn("error", error)
        .withColumn("rows", F.when(F.col("error").isNull(), F.transform("_rows", typed)))
        .drop("_rows")
    )


def accepted_rows(parsed: DataFrame) -> DataFrame:
    """The rows of the accepted requests in the shape of the classified table."""
    rows = unnest(good_rows(parsed), "rows", "_row")
    return rows.select(*[c for c in rows.columns if c != "_row"], "_row.*")


def submit(df: DataFrame, path: str, body: str = "value") -> DataFrame:
    """Append the accepted rows to the table; returns the rejected requests."""
    parsed = parse_submissions(df, body)
    write_classified(accepted_rows(parsed), path)
    return parsed.filter(F.col("error").isNotNull()).drop("rows")
