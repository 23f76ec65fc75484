"""Code tables, flags and JSON text defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def code_label(code: Column, table: Mapping[str, str]) -> Column:
    """Description of a code from a small fixed table; NULL when the code is unknown."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[code]


def first_known(*cols: Column) -> Column:
    return F.coalesce(*cols)


def yes_no(condition: Column) -> Column:
    """'J' where the condition holds, 'N' where it fails or is unknown."""
    return F.when(condition, F.lit("J")).otherwise(F.lit("N"))


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def json_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("{}"))


def json_field(c: Column, path: str, type_: str) -> Column:
    """One typed value out of JSON text, NULL for bad text, a missing path or a bad cast."""
    return F.try_variant_get(F.try_parse_json(c), path, type_)
