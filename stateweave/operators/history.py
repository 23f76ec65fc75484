"""State histories: numbering, successors, neighbours and the state at a moment.

A window over a hot key would sort that key in a single task.  Rows are reduced
to distinct states on the map side, and these are numbered and compared over
range partitions (``segments``), whatever the type of the columns they are
ordered by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.functions import dates
from stateweave.operators import segments
from stateweave.operators.predicates import not_empty_interval, valid_at

# Keys and states are structs: two NULL keys inside compare equal.
_KEY, _STATE = "__key", "__state"


def state_number(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "volgnummer") -> DataFrame:
    """Number the states of a key: dense rank by the order columns, NULL last.

    Distinct states are numbered over the whole frame by key and order; the rank
    is what a state's number is beyond the key's first.
    """
    states = df.select(F.struct(*key).alias(_KEY), F.struct(*order).alias(_STATE)).distinct()
    by = [F.col(_KEY).asc(), *(F.col(f"{_STATE}.`{o}`").asc_nulls_last() for o in order)]
    numbered = segments.numbered(segments.pinned(states, by), "__n")
    firsts = numbered.groupBy(_KEY).agg(F.min("__n").alias("__first"))
    ranked = numbered.join(firsts, _KEY).select(_KEY, _STATE, (F.col("__n") - F.col("__first") + 1).alias(out))
    rows = df.select("*", F.struct(*key).alias(_KEY), F.struct(*order).alias(_STATE))
    return rows.join(ranked, [_KEY, _STATE]).drop(_KEY, _STATE)


def successor_end(df: DataFrame, key: str, begin: str, end: str, take: Mapping[str, str]) -> DataFrame:
    """Left join to the successor state: same key, beginning where this one ends.

    Joined on both columns, so states with gaps stay without a successor and a
    hot key is spread by time.
    """
    side = df.select(
        F.col(key).alias("__key"), F.col(begin).alias("__begin"), *[F.col(c).alias(o) for o, c in take.items()]
    )
    condition = (F.col(key) == F.col("__key")) & (F.col(end) == F.col("__begin"))
    return df.join(side, condition, "left").drop("__key", "__begin")


def drop_empty_states(df: DataFrame, begin: str, end: str) -> DataFrame:
    return df.where(not_empty_interval(F.col(begin), F.col(end)))


def distinct_states(df: DataFrame, key: Sequence[str], begin: str, end: str) -> DataFrame:
    """One row per (key, begin, end) with the number of copies, reduced before the shuffle."""
    return df.groupBy(*key, begin, end).agg(F.count(F.lit(1)).alias("copies"))


def with_neighbours(
    df: DataFrame, key: Sequence[str], begin: str, end: str, next_begin: str = "next_begin", reached: str = "reached"
) -> DataFrame:
    """Begin of the following state of the key, and how far its earlier states reach: (open, until)."""
    by = [F.col(begin).asc_nulls_last(), F.col(end).asc_nulls_last()]
    until = F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("until"))
    return segments.with_neighbours(df, key, by, F.col(begin), until, next_begin, reached)


def with_next_begin(df: DataFrame, key: Sequence[str], begin: str, end: str, out: str = "next_begin") -> DataFrame:
    """Begin of the following state of the key, over distinct states."""
    return with_neighbours(df, key, begin, end, next_begin=out, reached="__reached").drop("__reached")


def current_at(
    df: DataFrame, as_of: str | date | datetime, begin: str, end: str, expiry: str | None = None
) -> DataFrame:
    """States in force at a moment."""
    at = dates.moment(as_of)
    return df.where(valid_at(at, F.col(begin), F.col(end), F.col(expiry) if expiry else None))
