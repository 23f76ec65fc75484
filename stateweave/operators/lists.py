"""Ordered lists of a key's values: as one text, or as rows.

Which of the two is a choice of the caller and not of the data: a text for lists
that are small by nature, such as the parts of an order, and rows for lists that
may grow without bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stateweave.operators.identity import global_number
from stateweave.operators.joining import same


def ordered_text(df: DataFrame, key: Sequence[str], value: str, out: str = "listing", sep: str = ";") -> DataFrame:
    """One row per key with its values in order, joined to one text; NULL values are left out."""
    text = F.expr(f"listagg(CAST(`{value}` AS STRING), '{sep}') WITHIN GROUP (ORDER BY `{value}`)")
    return df.where(F.col(value).isNotNull()).groupBy(*key).agg(text.alias(out))


def ordered_rows(df: DataFrame, key: Sequence[str], value: str, out: str = "value", position: str = "position", copies: str = "copies") -> DataFrame:
    """One row per key and distinct value: its position in the key's order, and how often it occurs.

    Copies are counted before the shuffle and positions come from range
    partitions over (key, value), so no task holds a key.  NULL values are left out.
    """
    key = list(key)
    runs = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias(out)).agg(F.count(F.lit(1)).alias(copies))
    numbered = global_number(runs, [*key, out], "__n")
    first = numbered.groupBy(*key).agg(F.min("__n").alias("__first"))
    joined = numbered.alias("n").join(first.alias("f"), same("n", "f", key))
    return joined.select(*[F.col(f"n.`{c}`") for c in key], (F.col("__n") - F.col("__first") + 1).alias(position), out, copies)
