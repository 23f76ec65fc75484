"""Comparison of a load with the current snapshot, and applying the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.operators.joining import same

ADD, MODIFY, CONFIRM, DELETE = "ADD", "MODIFY", "CONFIRM", "DELETE"


def changed_attributes(old: str, new: str, names: Sequence[str]) -> Column:
    """Names whose values differ between two struct columns, NULL equal to NULL."""
    return F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"{old}.`{n}`").eqNullSafe(F.col(f"{new}.`{n}`")), F.lit(n))
                for n in names
            ]
        )
    )


def snapshot_diff(
    current: DataFrame,
    load: DataFrame,
    key: Sequence[str],
    compare: Sequence[str] | None = None,
    mode: str = "full",
    source: str | None = None,
    loaded_sources: Sequence[str] | None = None,
    seen: DataFrame | None = None,
    seen_key: Sequence[str] | None = None,
) -> DataFrame:
    """Change set: key, action, changed attributes, and the loaded row as ``new``.

    Both snapshots are tagged and stacked, and one aggregate per key replaces a
    full outer join: it needs one exchange, combines on the map side, and a
    doubled key costs a row per task instead of a product.  ``doubled`` marks
    such keys; the greatest row stands for them.

    ``mode='partial'`` leaves keys absent from the load alone.  ``source`` names
    a lineage column: only rows of the loaded sources may be deleted.  These are
    the ones found in the load unless ``loaded_sources`` names them, which an
    empty full load needs.  ``seen`` holds keys (by ``seen_key``, a part of the
    key) that were delivered but not loaded: they are no DELETE.
    """
    key = list(key)
    group = [*key, source] if source else key
    columns = [c for c in load.columns if c not in key]
    compare = [c for c in columns if c != source] if compare is None else list(compare)

    def tagged(df: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in columns])
        empty = F.lit(None).cast(load.select(row.alias("r")).schema["r"].dataType)
        return df.select(
            *group,
            (row if side == "old" else empty).alias("__old"),
            (row if side == "new" else empty).alias("__new"),
            F.lit(1 if side == "old" else 0).alias("__no"),
            F.lit(1 if side == "new" else 0).alias("__nn"),
        )

    stacked = tagged(current, "old").unionByName(tagged(load, "new"))
    if source:
        # Sources are few; the set of those present is one small row.
        if loaded_sources is None:
            present = load.agg(F.collect_set(source).alias("s")).scalar()
        else:
            present = F.array(*[F.lit(s) for s in loaded_sources])
        stacked = stacked.where((F.col("__nn") == 1) | F.array_contains(present, F.col(source)))
    merged = stacked.groupBy(*group).agg(
        F.max("__old").alias("old"),
        F.max("__new").alias("new"),
        F.sum("__no").alias("__no"),
        F.sum("__nn").alias("__nn"),
    )
    if mode == "partial":
        merged = merged.where(F.col("__nn") > 0)
    elif mode != "full":
        raise ValueError(f"mode {mode!r} is neither full nor partial")
    both = (F.col("__no") > 0) & (F.col("__nn") > 0)
    changed = F.when(both, changed_attributes("old", "new", compare)).otherwise(F.array().cast("array<string>"))
    action = (
        F.when(F.col("__no") == 0, F.lit(ADD))
        .when(F.col("__nn") == 0, F.lit(DELETE))
        .when(F.size("changed") > 0, F.lit(MODIFY))
        .otherwise(F.lit(CONFIRM))
    )
    found = merged.withColumn("changed", changed).select(
        *group,
        action.alias("action"),
        "changed",
        ((F.col("__no") > 1) | (F.col("__nn") > 1)).alias("doubled"),
        "new",
    )
    return found if seen is None else spare(found, seen, list(seen_key or key))


def spare(found: DataFrame, seen: DataFrame, seen_key: Sequence[str]) -> DataFrame:
    """A change set without the DELETEs of keys that were delivered and not loaded."""
    delivered = seen.select(*seen_key).distinct().withColumn("__seen", F.lit(True))
    marked = found.alias("f").join(delivered.alias("s"), same("f", "s", seen_key), "left")
    return marked.where((F.col("f.action") != DELETE) | F.col("__seen").isNull()).select("f.*")


def apply_changes(current: DataFrame, changes: DataFrame, key: Sequence[str], source: str | None = None) -> DataFrame:
    """Snapshot after the change set: changed and deleted rows out, added and modified rows in."""
    group = [*key, source] if source and source not in key else list(key)
    gone = changes.where(F.col("action").isin(MODIFY, DELETE)).select(*group)
    written = changes.where(F.col("action").isin(ADD, MODIFY))
    rows = written.select(
        *[F.col(c) if c in key else F.col(f"new.`{c}`").alias(c) for c in current.columns]
    )
    # NULL in a key equals NULL, as in the comparison.
    return current.alias("c").join(gone.alias("g"), same("c", "g", group), "left_anti").unionByName(rows)


def stack_sources(parts: dict[str, DataFrame], source: str = "_source") -> DataFrame:
    """One entity out of several sources, each row labelled with its source."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(source, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
