"""Stable identifiers from a template such as ``1234XXXXX``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.functions.text import null_if_empty
from stateweave.operators import segments


def template_parts(template: str) -> tuple[str, int]:
    """Fixed prefix and number of digits."""
    prefix = template.rstrip("X")
    if not prefix or prefix == template:
        raise ValueError(f"template {template!r} needs a prefix and a run of X")
    return prefix, len(template) - len(prefix)


def sequence_of(id_: Column, template: str) -> Column:
    """Sequence number of an identifier that fits the template, else NULL."""
    prefix, width = template_parts(template)
    fits = id_.startswith(prefix) & (F.length(id_) == len(prefix) + width)
    return F.when(fits, F.substring(id_, len(prefix) + 1, width).try_cast("bigint"))


def max_sequence(df: DataFrame, id_: str, template: str) -> DataFrame:
    """Highest sequence in use for the template, one row (0 when there is none)."""
    return df.agg(F.coalesce(F.max(sequence_of(F.col(id_), template)), F.lit(0)).cast("bigint").alias("max_sequence"))


def global_number(df: DataFrame, column: str | Column | Sequence[str | Column], out: str, partitions: int | None = None) -> DataFrame:
    """Number distinct values of one or more columns 1..n in order over the whole frame without one big window."""
    columns = [column] if isinstance(column, (str, Column)) else list(column)
    return segments.numbered(segments.pinned(df, columns, partitions), out).select(*df.columns, out)


def autoid(df: DataFrame, on: str, id_: str, template: str, registry: DataFrame | None = None) -> DataFrame:
    """Fill missing identifiers.

    A supplied id is kept as it is.  Otherwise the registry's id of the same
    value is used, then an id supplied in this batch for the same value, then a
    new one: prefix and zero-padded sequence, counting on from the highest in
    batch and registry in order of the value.  Gaps are not filled, a NULL value
    gets no id, and a sequence too long for the template is an error.
    """
    prefix, width = template_parts(template)
    given = null_if_empty(F.col(id_))
    batch_ids = df.where(given.isNotNull()).select(F.col(on).alias("__on"), given.alias("__id"))
    pool = batch_ids.withColumn("__rank", F.lit(1))
    if registry is not None:
        old = registry.where(null_if_empty(F.col(id_)).isNotNull())
        old = old.select(F.col(on).alias("__on"), F.col(id_).alias("__id"), F.lit(0).alias("__rank"))
        pool = old.unionByName(pool)
    known = (
        pool.where(F.col("__on").isNotNull())
        .groupBy("__on")
        .agg(F.min(F.struct("__rank", "__id")).getField("__id").alias("__known"))
    )
    wanted = df.where(given.isNull() & F.col(on).isNotNull()).select(F.col(on).alias("__on")).distinct()
    fresh = global_number(wanted.join(known, "__on", "left_anti"), "__on", "__seq")
    top = max_sequence(pool, "__id", template).scalar()
    text = (F.col("__seq") + top).cast("string")
    new_id = F.when(F.length(text) > width, F.raise_error(F.lit(f"identifiers of {template} are used up"))).otherwise(
        F.concat(F.lit(prefix), F.lpad(text, width, "0"))
    )
    assigned = known.unionByName(fresh.select("__on", new_id.alias("__known")))
    joined = df.join(assigned, F.col(on) == F.col("__on"), "left")
    return joined.withColumn(id_, F.coalesce(given, F.col("__known"))).drop("__on", "__known")
