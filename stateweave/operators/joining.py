"""Null-safe join conditions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def same(left: str, right: str, names: Sequence[str]) -> Column:
    """Null-safe equality of the named columns of two aliased frames; still a hash join for Spark."""
    pairs = [F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`")) for n in names]
    return reduce(lambda a, b: a & b, pairs)
