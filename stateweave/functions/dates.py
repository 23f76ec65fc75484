"""Dates: rendering, truncation, fixed points in time and strptime patterns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

DAY = "yyyy-MM-dd"
MOMENT = "yyyy-MM-dd HH:mm:ss"

# strptime directive -> Spark pattern letters (fixed values).
_DIRECTIVES = {
    "%Y": "yyyy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
}


def spark_pattern(fmt: str) -> str:
    """Translate a strptime format to a Spark datetime pattern."""
    out, i = [], 0
    while i < len(fmt):
        piece = fmt[i : i + 2]
        if piece in _DIRECTIVES:
            out.append(_DIRECTIVES[piece])
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"date directive {piece!r} is not supported")
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def day_text(c: Column) -> Column:
    return F.date_format(c, DAY)


def moment_text(c: Column) -> Column:
    return F.date_format(c, MOMENT)


def moment(value: str | datetime) -> Column:
    """A timestamp constant; a bare date means midnight."""
    return F.lit(str(value)).cast("timestamp")


def day_of(c: Column) -> Column:
    return F.to_date(c)


def days_before(as_of: str | datetime, days: int) -> Column:
    return moment(as_of) - F.make_dt_interval(F.lit(days))
