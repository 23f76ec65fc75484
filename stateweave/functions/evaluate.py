"""Keep a costly expression from being evaluated once per use.

Catalyst merges projections and pushes filters down by copying expressions.
That is right for cheap ones; parsed geometries and error lists are not cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a column computed once per row; a generator's output is never copied into later expressions."""
    return df.withColumn(name, F.explode(F.array(value)))
