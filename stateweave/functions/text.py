"""Text functions that keep the source databases' answers for NULL, '' and positions.

Oracle treats '' as NULL and concatenates NULL as nothing; T-SQL's
``SUBSTRING(s, 0, n)`` yields n - 1 characters.  Each function states which rule
it keeps.  All are plain Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GAP = "   "
BREAK = "\n"


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def upper_slice(c: Column, start: int, length: int) -> Column:
    return F.upper(F.substring(c, start, length))


def strip_ends(c: Column) -> Column:
    """Drop the first and the last character (braces around a GUID)."""
    return null_if_empty(F.substring(c, F.lit(2), F.length(c) - 2))


def join_codes(*parts: Column) -> Column:
    """Concatenate, NULL as nothing; NULL when nothing is left."""
    return null_if_empty(F.concat_ws("", *parts))


def prefix_before(c: Column, stops: str = "_ ") -> Column:
    """Text before the first of the stop characters; '' when none occurs (T-SQL rule)."""
    stop_class = "".join("\\" + s if s in "\\]^-" else s for s in stops)
    return F.regexp_extract(c, f"^([^{stop_class}]*)[{stop_class}]", 1)


def file_code(c: Column, width: int = 21) -> Column:
    """Code of a document file: up to the first '_' of the leading text, else all of it, trimmed."""
    head = F.substring(c, 1, width)
    return null_if_empty(F.trim(F.coalesce(null_if_empty(F.regexp_extract(head, "^(.*?)_", 1)), head)))


def break_position(c: Column) -> Column:
    """1-based position of the first triple space, line feed or '('; 0 when there is none."""
    marked = F.replace(F.replace(c, F.lit(GAP), F.lit(BREAK)), F.lit("("), F.lit(BREAK))
    return F.instr(marked, BREAK)


def address_part(c: Column) -> Column:
    """Text before the first break, or all of it."""
    at = break_position(c)
    return F.when(at == 0, c).otherwise(null_if_empty(F.substring(c, F.lit(1), at - 1)))


def location_part(c: Column) -> Column:
    """Text after the first break, left-trimmed; NULL without a break.

    Here '(' counts as three spaces, so after 'abc ' the break lies one
    character earlier and the bracket stays in the answer.
    """
    marked = F.replace(F.replace(c, F.lit("("), F.lit(GAP)), F.lit(GAP), F.lit(BREAK))
    rest = F.substring(c, F.instr(marked, BREAK) + 1, F.length(c))
    return F.when(break_position(c) == 0, F.lit(None)).otherwise(null_if_empty(F.ltrim(rest)))
