"""Typed conversion of source text; NULL where a value does not fit its type.

Spark's ANSI mode raises on a bad cast, so only the ``try_`` family is used: a
bad value costs its row a quarantine entry, never the job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stateweave.functions import dates, wkt
from stateweave.functions.evaluate import let
from stateweave.functions.text import null_if_empty

# Boolean formats: text for true, text for false (fixed values).
BOOLEAN_FORMATS = {"JN": ("J", "N"), "10": ("1", "0")}

SPARK_TYPES = {
    "string": "string",
    "character": "string",
    "integer": "int",
    "biginteger": "bigint",
    "decimal": "decimal(18,4)",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp",
    "incomplete_date": "struct<year:int,month:int,day:int,text:string>",
    "json": "string",
    "point": "string",
    "polygon": "string",
    "geometry": "string",
    "reference": "struct<bronwaarde:string>",
    "manyreference": "array<struct<bronwaarde:string>>",
    "secure_string": "string",
    "secure_number": "string",
    "secure_datetime": "timestamp",
}


def to_timestamp(c: Column, fmt: str | None = None) -> Column:
    """Timestamp from text in a strptime format, ISO when none is given."""
    if fmt is None:
        return c.try_cast("timestamp")
    return F.try_to_timestamp(c, F.lit(dates.spark_pattern(fmt)))


def to_date(c: Column, fmt: str | None = None) -> Column:
    return c.try_cast("date") if fmt is None else to_timestamp(c, fmt).cast("date")


def to_boolean(c: Column, fmt: str | None = None) -> Column:
    if fmt is None:
        return c.try_cast("boolean")
    true, false = BOOLEAN_FORMATS[fmt]
    return F.when(c == true, F.lit(True)).when(c == false, F.lit(False))


def to_character(c: Column) -> Column:
    return F.when(F.length(c) == 1, c)


def to_incomplete_date(c: Column) -> Column:
    """Year, month and day of a date whose month or day may be 00 (unknown)."""
    part = lambda n: F.nullif(F.regexp_extract(c, r"^(\d{4})-(\d{2})-(\d{2})$", n).try_cast("int"), F.lit(0))
    year, month, day = part(1), part(2), part(3)
    whole = c.try_cast("date").isNotNull()
    month_only = c.rlike(r"^\d{4}-(0[1-9]|1[0-2])-00$")
    year_only = c.rlike(r"^\d{4}-00-00$")
    fits = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & (whole | month_only | year_only)
    return F.when(
        fits, F.struct(year.alias("year"), month.alias("month"), day.alias("day"), c.alias("text"))
    )


def to_json(c: Column) -> Column:
    """The text itself when it is valid JSON."""
    return F.when(F.try_parse_json(c).isNotNull(), c)


def convert(c: Column, type_: str, fmt: str | None = None) -> Column:
    """Convert source text to the named attribute type."""
    text = null_if_empty(c.cast("string"))
    kind = type_.removeprefix("secure_")
    if kind == "number":
        return text
    if kind == "string":
        return text
    if kind == "character":
        return to_character(text)
    if kind in ("integer", "biginteger", "decimal"):
        return text.try_cast(SPARK_TYPES[kind])
    if kind == "boolean":
        return to_boolean(text, fmt)
    if kind == "date":
        return to_date(text, fmt)
    if kind == "datetime":
        return to_timestamp(text, fmt)
    if kind == "incomplete_date":
        return let(text, to_incomplete_date)
    if kind == "json":
        return to_json(text)
    if kind == "point":
        return let(text, lambda v: F.when(wkt.is_point(v), v))
    if kind == "polygon":
        return let(text, lambda v: F.when(wkt.is_polygon(v), v))
    if kind == "geometry":
        return let(text, lambda v: F.when(wkt.is_geometry(v), v))
    if kind == "reference":
        return F.when(text != "null", text)
    raise ValueError(f"no conversion for type {type_!r}")


def is_bad(c: Column, type_: str, fmt: str | None = None) -> Column:
    """True where a value is present but does not fit the type."""
    present = null_if_empty(c.cast("string")).isNotNull()
    return present & convert(c, type_, fmt).isNull()
