"""Queries over the given tables, each with the SQL that must give the same rows."""

from checks.registry import CHECKS

from checks import (  # noqa: F401  (importing a module registers its queries)
    aggregates,
    changes,
    composites,
    conversions,
    filters,
    history,
    joins,
    mapping,
    quality,
    relations,
    scalars,
    scans,
    space,
)

__all__ = ["CHECKS"]
