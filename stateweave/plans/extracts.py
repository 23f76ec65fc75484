"""Plain register extracts drawn up from their definition.

Most register queries only list the columns the definition's mapping reads.  So
the list need not be written twice: the mapping says which columns are needed,
the table's schema where each is found, and only what differs from a plain copy
is stated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from stateweave.operators.projection import Extract
from stateweave.plans.definition import Definition, DefinitionError


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def needed_columns(definition: Definition) -> list[str]:
    """Source columns the mapping reads, the heads of dotted paths among them, in order of first use."""
    names: dict[str, None] = {definition.entity_id: None}
    for attribute, spec in definition.mapping.items():
        if attribute in definition.not_provided:
            continue
        source = spec["source_mapping"]
        if isinstance(source, Mapping):
            values = [v for k, v in source.items() if k != "format"]
        else:
            values = [source]
        for value in values:
            if not value.startswith("="):
                names[value.split(".")[0]] = None
    return list(names)


def draw_up(
    definition: Definition,
    table: DataFrame,
    names: Mapping[str, str] | None = None,
    constants: Mapping[str, tuple[object, str]] | None = None,
    dates: Iterable[str] = (),
    integers: Iterable[str] = (),
    flags: Iterable[str] = (),
    json: Iterable[str] = (),
    json_or_empty: Iterable[str] = (),
) -> Extract:
    """Extract of a prepared table for a definition.

    A column is found by its own name, by a ``names`` entry, or by the camel-case
    spelling of its name.  One that is found nowhere and is no constant is an error.
    """
    names, constants = dict(names or {}), dict(constants or {})
    spelled = {snake_case(c): c for c in table.columns} | {c.lower(): c for c in table.columns}
    columns, missing = [], []
    for name in needed_columns(definition):
        source = names.get(name) or spelled.get(name.lower())
        if source:
            columns.append((name, f"`{source}`"))
        elif name not in constants:
            missing.append(name)
    if missing:
        raise DefinitionError(f"{definition.table} needs columns its table lacks: {missing}")
    return Extract(
        columns, frozenset(dates), frozenset(integers), frozenset(flags), frozenset(json), frozenset(json_or_empty), constants
    )
