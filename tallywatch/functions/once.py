"""Evaluate a costly row expression once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_fields(df: DataFrame, fields: Column) -> DataFrame:
    """Add the fields of a struct as columns.

    The struct goes through ``inline``, a generator, so the optimizer neither repeats
    its expression per field nor copies it into a filter that is put on a field.
    """
    return df.select("*", F.inline(F.array(fields)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
