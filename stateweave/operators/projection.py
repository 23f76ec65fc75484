"""Flat projections: alias, constant, typed NULL, rename and the plain register extract."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.functions import convert, dates, values


def select_as(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Project to ``{output name: source column or expression}``."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(out) for out, c in columns.items()])


def with_constants(df: DataFrame, constants: Mapping[str, tuple[object, str]]) -> DataFrame:
    """Append typed constants, ``{name: (value or None, type)}``."""
    return df.select("*", *[F.lit(v).cast(t).alias(name) for name, (v, t) in constants.items()])


def add_not_provided(df: DataFrame, attributes: Mapping[str, str]) -> DataFrame:
    """Typed NULL columns for attributes the source does not deliver."""
    return with_constants(df, {name: (None, type_) for name, type_ in attributes.items()})


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename quoted mixed-case source columns; an absent one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the extract: {missing}")
    return df.withColumnsRenamed(dict(names))


def lowercase_keys(df: DataFrame) -> DataFrame:
    """Lower-case the header; two headers that meet are an error."""
    lower = [c.lower() for c in df.columns]
    if len(set(lower)) < len(lower):
        raise ValueError("headers differ by case only")
    return df.toDF(*lower)


@dataclass(frozen=True)
class Extract:
    """A plain register extract: which columns to take and how each is rendered.

    ``columns`` keeps the output order; an entry is ``name`` or ``(output, source)``.
    The other fields name output columns that need more than a copy.
    """

    columns: Iterable[str | tuple[str, str]]
    dates: frozenset[str] = frozenset()
    integers: frozenset[str] = frozenset()
    flags: frozenset[str] = frozenset()
    json: frozenset[str] = frozenset()
    json_or_empty: frozenset[str] = frozenset()
    constants: Mapping[str, tuple[object, str]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for entry in self.columns:
            name, source = (entry, entry) if isinstance(entry, str) else entry
            out.append(self._render(name, F.col(source)).alias(name))
        for name, (value, type_) in self.constants.items():
            out.append(F.lit(value).cast(type_).alias(name))
        return df.select(*out)

    def _render(self, name: str, c: Column) -> Column:
        if name in self.dates:
            return dates.day_of(c)
        if name in self.integers:
            return values.to_int(c)
        if name in self.flags:
            return values.yes_no(c)
        if name in self.json:
            return convert.to_json(c)
        if name in self.json_or_empty:
            return convert.to_json(values.json_or_empty(c))
        return c
