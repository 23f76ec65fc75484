"""Joins that add columns: code lookups, parents, previous records, latest rows, merged datasets.

No join carries a broadcast hint.  Spark compares the measured size of a side
with ``autoBroadcastJoinThreshold``, so small code tables are broadcast and a
table that has grown is shuffled; hot keys are split by the skew-join rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def lookup(df: DataFrame, dim: DataFrame, on: Mapping[str, str], take: Mapping[str, str]) -> DataFrame:
    """Left join to a code table; ``take`` is ``{output: column of the table}``."""
    keys = {v: f"__k{i}" for i, v in enumerate(on.values())}
    side = dim.select(*[F.col(c).alias(k) for c, k in keys.items()], *[F.col(c).alias(o) for o, c in take.items()])
    condition = None
    for left, right in on.items():
        eq = F.col(left) == F.col(keys[right])
        condition = eq if condition is None else condition & eq
    return df.join(side, condition, "left").drop(*keys.values())


def with_parent(
    df: DataFrame, child_key: str, parent_key: str, take: Mapping[str, str | Column], where: Column | None = None
) -> DataFrame:
    """Inner self-join child to parent; ``where`` filters the parents before the join."""
    parents = df if where is None else df.where(where)
    side = parents.select(
        F.col(parent_key).alias("__parent"),
        *[(F.col(c) if isinstance(c, str) else c).alias(o) for o, c in take.items()],
    )
    return df.join(side, F.col(child_key) == F.col("__parent")).drop("__parent")


def with_previous(df: DataFrame, previous: Mapping[str, str | Column], take: Mapping[str, str]) -> DataFrame:
    """Left self-join to the record ``{column of the record: expression on this row}`` names."""
    names = {c: f"__p{i}" for i, c in enumerate(previous)}
    side = df.select(*[F.col(c).alias(n) for c, n in names.items()], *[F.col(c).alias(o) for o, c in take.items()])
    condition = None
    for column, here in previous.items():
        eq = F.col(names[column]) == (F.col(here) if isinstance(here, str) else here)
        condition = eq if condition is None else condition & eq
    return df.join(side, condition, "left").drop(*names.values())


def latest_by(df: DataFrame, key: Sequence[str], order: str, pool: DataFrame | None = None) -> DataFrame:
    """Rows that carry the latest value of their key, ties kept.

    The maximum is pre-aggregated on the map side and joined back on key *and*
    value, so a hot key is spread by its values instead of sorted in one task.
    ``pool`` gives the maximum a different (unfiltered) row set.
    """
    tops = (df if pool is None else pool).groupBy(*key).agg(F.max(order).alias(order))
    condition = None
    for c in (*key, order):
        eq = F.col(f"a.`{c}`") == F.col(f"m.`{c}`")
        condition = eq if condition is None else condition & eq
    return df.alias("a").join(tops.alias("m"), condition).select("a.*")


def latest_one(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One latest row per key: the maximum of (order columns, then all others) as one aggregate."""
    rest = [c for c in df.columns if c not in key and c not in order]
    top = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__top"))
    return top.select(*key, "__top.*").select(*df.columns)


def asof_latest(
    df: DataFrame, facts: DataFrame, key: str, fact_key: str, order: str, take: Mapping[str, str], dedupe: bool = False
) -> DataFrame:
    """Left join each row to its latest fact; ties multiply unless ``dedupe`` keeps one."""
    latest = latest_one(facts, [fact_key], [order]) if dedupe else latest_by(facts, [fact_key], order)
    return lookup(df, latest, {key: fact_key}, take)


def merge_dataset(df: DataFrame, other: DataFrame, on: str, copy: Sequence[str], other_on: str | None = None) -> DataFrame:
    """Fill NULLs of the primary from a second dataset, one row per key (fullest, then lowest)."""
    other_on = other_on or on
    fullest = F.min(F.struct(*[F.col(c).isNull().alias(f"n_{c}") for c in copy], *copy)).alias("__row")
    side = other.where(F.col(other_on).isNotNull()).groupBy(F.col(other_on).alias("__on")).agg(fullest)
    joined = df.join(side, F.col(on) == F.col("__on"), "left")
    filled = {
        c: F.coalesce(F.col(c), F.col(f"__row.{c}")) if c in df.columns else F.col(f"__row.{c}") for c in copy
    }
    return joined.withColumns(filled).drop("__on", "__row")


def semi(df: DataFrame, other: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows whose key occurs in the other frame."""
    side = other.select(*[F.col(r).alias(l) for l, r in on.items()])
    return df.join(side, list(on), "left_semi")


def in_any(df: DataFrame, column: str, sets: Sequence[DataFrame], or_else: Column) -> DataFrame:
    """``column IN (set 1) OR column IN (set 2) OR predicate`` with one join.

    The sets are single-column frames; their union is reduced to distinct values
    before it is shuffled, and a marker join replaces one existence join per set.
    """
    members = None
    for s in sets:
        one = s.select(F.col(s.columns[0]).alias("__member"))
        members = one if members is None else members.unionByName(one)
    members = members.distinct()
    joined = df.join(members, F.col(column) == F.col("__member"), "left")
    return joined.where(F.col("__member").isNotNull() | or_else).drop("__member")


__all__ = [
    "asof_latest",
    "in_any",
    "latest_by",
    "latest_one",
    "lookup",
    "merge_dataset",
    "semi",
    "with_parent",
    "with_previous",
]
