"""Ordered work within keys of any size: range partitions, and what one hands on to the next.

A window over a key sorts that key in one task.  Here rows are dealt to range
partitions by key and order, so that a hot key lies in many of them; a segment is
the part of a key in one partition.  Windows see a segment at most, each segment
gives one row of summary, and a key's summaries, one a partition, are carried on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stateweave.session import staged

PART, PLACE = "__part", "__place"


def pinned(df: DataFrame, order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Range partitions by ``order``, with the columns of a row's partition and its place there.

    They are written once to the shared folder: bounds come from a sample, so a
    second run might cut elsewhere, and a lost executor must not change a number.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = staged(ranged.withColumn(PLACE, F.monotonically_increasing_id()), "ranged")
    inside = F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    return table.select(*df.columns, F.shiftright(PLACE, 33).alias(PART), inside.alias(PLACE))


def numbered(placed: DataFrame, out: str) -> DataFrame:
    """Number the rows of a pinned frame 1..n; only one count per partition goes through a window."""
    counts = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row per partition, so the broadcast has a fixed bound.
    return placed.join(F.broadcast(offsets), PART).withColumn(out, (F.col("__before") + F.col(PLACE) + 1).cast("bigint")).drop("__before")


def with_neighbours(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], leading: Column, running: Column, next_: str, reached: str
) -> DataFrame:
    """Append ``leading`` of the next row of the key, and the greatest ``running`` of all its earlier rows.

    NULL where there is none; NULLs of ``running`` are passed over.  A key with rows
    in several partitions comes first in all of them but one, so that at most two
    rows a partition are carried and no other key passes through a second exchange.
    """
    of = F.struct(*key)
    placed = pinned(df.select("*", leading.alias("__leading"), running.alias("__running")), [*(F.col(k).asc() for k in key), *order])
    within = Window.partitionBy(PART, *key).orderBy(PLACE)
    inner = placed.withColumn("__next", F.lead("__leading").over(within)).withColumn("__last", F.lead(F.lit(1)).over(within).isNull())
    inner = inner.withColumn("__inside", F.max("__running").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    # Two rows per partition at most, so both broadcasts have a fixed bound.
    heads = placed.where(F.col(PLACE) == 0).select(of.alias("__key")).distinct()
    first = F.min_by("__leading", PLACE).alias("__first")
    segments = placed.join(F.broadcast(heads), of == F.col("__key")).groupBy(PART, "__key").agg(first, F.max("__running").alias("__top"))
    along = Window.partitionBy("__key").orderBy("__of")
    carried = segments.withColumnRenamed(PART, "__of").select(
        "__of", "__key", F.lead("__first").over(along).alias("__later"),
        F.max("__top").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"),
    )
    following = F.when(F.col("__last"), F.col("__later")).otherwise(F.col("__next"))
    # greatest() passes over NULL.
    return inner.join(F.broadcast(carried), (F.col(PART) == F.col("__of")) & (of == F.col("__key")), "left").select(
        *df.columns, following.alias(next_), F.greatest("__inside", "__carry").alias(reached)
    )
