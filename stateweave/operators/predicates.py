"""Row predicates the register queries share; every one is a Column, so it reaches the scan where it can."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, functions as F

from stateweave.functions import dates


def not_empty_interval(begin: Column, end: Column) -> Column:
    """False for states of zero length; an open end is never empty."""
    return (begin != end) | end.isNull()


def code_in(c: Column, start: int, length: int, codes: Iterable[str]) -> Column:
    """The upper-cased code at a position is one of the listed codes."""
    return F.upper(F.substring(c, start, length)).isin(*codes)


def alive(*deleted: Column) -> Column:
    """No soft-delete marker is set on any side."""
    out = F.lit(True)
    for c in deleted:
        out = out & c.isNull()
    return out


def except_row(**values: object) -> Column:
    """Everything but the one row with these values (SQL NULL rules)."""
    same = F.lit(True)
    for name, v in values.items():
        same = same & (F.col(name) == F.lit(v))
    return ~same


def recent(c: Column, as_of: str | datetime, days: int = 10) -> Column:
    """Registered in the last days before a fixed moment."""
    return c >= dates.days_before(as_of, days)


def rotating_sample(key: Column, as_of: str | date, parts: int = 10) -> Column:
    """The part of the keys whose turn it is on this day of the month."""
    day = F.dayofmonth(F.lit(str(as_of)).cast("date"))
    return key.cast("bigint") % parts == day % parts


def valid_at(moment: Column, begin: Column, end: Column, expiry: Column | None = None) -> Column:
    """State is in force at the moment (half-open interval) and the row is not expired."""
    inside = (begin <= moment) & (end.isNull() | (moment < end))
    return inside if expiry is None else inside & (expiry.isNull() | (expiry > moment))
