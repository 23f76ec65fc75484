"""Validation and load guards.  Checks return frames, so a bad row is data and not an exception."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.functions import convert
from stateweave.functions.evaluate import once
from stateweave.operators import history

AttributeTypes = Mapping[str, tuple[str, str | None]]


def with_errors(df: DataFrame, attributes: AttributeTypes, out: str = "_errors") -> DataFrame:
    """Append the bad attributes of each row as an array of (attribute, value)."""
    found = [
        F.when(
            convert.is_bad(F.col(name), type_, fmt),
            F.struct(F.lit(name).alias("attribute"), F.col(name).cast("string").alias("value")),
        )
        for name, (type_, fmt) in attributes.items()
    ]
    return once(df, out, F.array_compact(F.array(*found)))


def split_valid(df: DataFrame, attributes: AttributeTypes, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, quarantine rows (key, attribute, value))."""
    checked = with_errors(df, attributes)
    good = checked.where(F.size("_errors") == 0).drop("_errors")
    bad = checked.select(*key, F.explode("_errors").alias("e")).select(*key, "e.attribute", "e.value")
    return good, bad


def field_count(line: Column, separator: str = ",") -> Column:
    """Number of fields of a delimited line without quoted separators."""
    return F.size(F.split(line, "\\" + separator if separator in "|.*+?^$()[]{}\\" else separator, -1))


def wrong_field_count(lines: DataFrame, column: str, expected: int, separator: str = ",") -> DataFrame:
    n = field_count(F.col(column), separator)
    return lines.withColumn("n_fields", n.cast("bigint")).where(F.col("n_fields") != expected)


def row_guard(loads: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """One row per dataset: (dataset, rows, min_rows, ok).  Only counts leave the executors."""
    out = None
    for name, (df, min_rows) in loads.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"),
            "rows",
            F.lit(min_rows).cast("bigint").alias("min_rows"),
            (F.col("rows") >= min_rows).alias("ok"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def completeness(mapped: DataFrame, not_provided: DataFrame, model: DataFrame) -> DataFrame:
    """Attributes that break the contract 'mapped or not provided = model', per dataset.

    All three are (dataset, attribute) frames.  One tagged union and one
    aggregate answer every question: missing, unknown and listed twice.
    """
    tag = lambda df, m, n, k: df.select(
        "dataset", "attribute", F.lit(m).alias("m"), F.lit(n).alias("n"), F.lit(k).alias("k")
    )
    tagged = tag(mapped, 1, 0, 0).unionByName(tag(not_provided, 0, 1, 0)).unionByName(tag(model, 0, 0, 1))
    seen = tagged.groupBy("dataset", "attribute").agg(F.max("m").alias("m"), F.max("n").alias("n"), F.max("k").alias("k"))
    m, n, k = F.col("m") == 1, F.col("n") == 1, F.col("k") == 1
    problem = (
        F.when(~k, F.lit("unknown")).when(~m & ~n, F.lit("missing")).when(m & n, F.lit("overlap"))
    )
    return seen.select("dataset", "attribute", problem.alias("problem")).where(F.col("problem").isNotNull())


def uncovered_columns(needed: DataFrame, delivered: DataFrame) -> DataFrame:
    """(dataset, column) a mapping needs and the extract lacks."""
    return needed.distinct().join(delivered.distinct(), ["dataset", "column"], "left_anti")


def duplicate_definitions(definitions: DataFrame) -> DataFrame:
    """(catalogue, entity) pairs with an application defined twice or more than one default."""
    per_app = definitions.groupBy("catalogue", "entity", "application").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_default").cast("int")).alias("d")
    )
    return (
        per_app.groupBy("catalogue", "entity")
        .agg(
            F.sum((F.col("n") > 1).cast("bigint")).alias("doubled_applications"),
            F.sum("d").cast("bigint").alias("defaults"),
        )
        .where((F.col("doubled_applications") > 0) | (F.col("defaults") > 1))
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in one load."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def interval_problems(df: DataFrame, key: Sequence[str], begin: str, end: str) -> DataFrame:
    """Distinct states that end before they begin, are doubled, overlap another one or leave a gap to the next.

    A state is compared with all earlier ones of its key: it overlaps if one of
    them still runs when it begins, or if the next begins before it ends, and a
    gap is left where nothing begun so far reaches the next begin.  A state of
    zero length counts as its moment.
    """
    states = history.with_neighbours(history.distinct_states(df, key, begin, end), key, begin, end)
    b, e, nxt, reached = F.col(begin), F.col(end), F.col("next_begin"), F.col("reached.until")
    still_open = F.coalesce("reached.open", F.lit(False))
    problem = (
        F.when(e < b, F.lit("reversed"))
        .when(F.col("copies") > 1, F.lit("doubled"))
        .when((e.isNull() & nxt.isNotNull()) | (nxt < e) | still_open | (b < reached), F.lit("overlap"))
        .when(nxt > F.greatest(e, reached), F.lit("gap"))
    )
    return states.withColumn("problem", problem).drop("reached").where(F.col("problem").isNotNull())
