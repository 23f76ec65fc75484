"""Relations between entities: by key, by attribute, in time, by shared key, and the dangling ones.

A relation is a long frame, one row per (source state, reference, destination
state); nothing is collected per source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stateweave.operators import segments
from stateweave.operators.mapping import REF
from stateweave.session import staged

# Cell lengths grow by 2^4 from level to level: few levels to enter a begin at, and
# cells at most sixteen times as long as an interval filed there.
LEVEL_STEP = 4


def explode_references(df: DataFrame, attribute: str, keep: Sequence[str]) -> DataFrame:
    """One row per reference of a single or many-reference attribute; rows without any are kept."""
    kind = df.schema[attribute].dataType
    if isinstance(kind, T.ArrayType):
        return df.select(*keep, F.explode_outer(attribute).alias("__ref")).select(*keep, "__ref.*")
    return df.select(*keep, f"{attribute}.*")


def resolve_references(
    refs: DataFrame, dst: DataFrame, dst_key: str, dst_attribute: str, multiple: bool = False, out: str = "dst_id"
) -> DataFrame:
    """Left join reference rows to their destination.

    With ``multiple`` every destination with the attribute value counts (one row
    each); otherwise the lowest key wins, chosen by a pre-aggregated minimum.
    """
    side = dst.where(F.col(dst_attribute).isNotNull())
    if multiple:
        side = side.select(F.col(dst_attribute).alias("__value"), F.col(dst_key).alias(out))
    else:
        side = side.groupBy(F.col(dst_attribute).alias("__value")).agg(F.min(dst_key).alias(out))
    return refs.join(side, F.col(REF) == F.col("__value"), "left").drop("__value")


def dangling(refs: DataFrame, dst: DataFrame, dst_attribute: str) -> DataFrame:
    """References that are set but resolve to nothing; the text ``null`` never resolves."""
    side = dst.select(F.col(dst_attribute).alias(REF)).distinct()
    return refs.where(F.col(REF).isNotNull()).join(side, REF, "left_anti")


def relate_inverse(owner: DataFrame, members: DataFrame, shared: str, member_shared: str, member_key: Sequence[str]) -> DataFrame:
    """Members that carry the owner's key, one row each; an owner without members stays with NULLs."""
    side = members.select(F.col(member_shared).alias("__shared"), *member_key)
    return owner.join(side, F.col(shared) == F.col("__shared"), "left").drop("__shared")


@dataclass(frozen=True)
class Side:
    """Column names of one end of a temporal relation; leave out what the entity does not have."""

    key: str
    match: str
    number: str | None = None
    begin: str | None = None
    end: str | None = None

    def standard(self, df: DataFrame, prefix: str, extra: Column | None = None) -> DataFrame:
        pick = lambda name, type_: (F.col(name) if name else F.lit(None)).cast(type_)
        begin = pick(self.begin, "timestamp")
        return df.select(
            F.col(self.key).alias(f"{prefix}_id"),
            pick(self.number, "bigint").alias(f"{prefix}_number"),
            F.col(self.match).alias(f"{prefix}_match"),
            (begin if extra is None else F.greatest(begin, extra.cast("timestamp"))).alias(f"{prefix}_begin"),
            pick(self.end, "timestamp").alias(f"{prefix}_end"),
            begin.alias(f"{prefix}_own_begin"),
        )


def _spans(src: DataFrame, dst: DataFrame) -> DataFrame:
    """For each match value, the span of its begins in microseconds, and their number."""
    begins = src.select(F.col("s_match").alias("__value"), F.unix_micros("s_begin").alias("__b")).unionByName(
        dst.select(F.col("d_match").alias("__value"), F.unix_micros("d_begin").alias("__b"))
    )
    return begins.where(F.col("__value").isNotNull()).groupBy("__value").agg(
        F.coalesce(F.min("__b"), F.lit(0)).alias("__from"),
        F.coalesce(F.max("__b"), F.lit(0)).alias("__to"),
        F.count(F.lit(1)).alias("__n"),
    )


def _grid_level(duration: Column) -> Column:
    """Grid level of a duration: the bits it needs, rounded up to a step, so that 2^level exceeds it."""
    return (F.ceil(F.length(F.bin(duration)) / LEVEL_STEP) * LEVEL_STEP).cast("int")


def _placed(df: DataFrame, p: str, spans: DataFrame, begins: str, interval: str) -> DataFrame:
    """One row per place an interval is to be met at.

    It is filed (kind ``interval``) under the cells of its level, one or two of
    them, and its begin is entered (kind ``begins``) at every level of its value.
    These lead from the mean distance of the value's begins to their span: one
    or two levels for a value with a few states, half a dozen for one with
    millions.  Open ends reach as far as any begin of the value.
    """
    marked = df.join(spans, F.col(f"{p}_match") == F.col("__value"))
    beyond = F.col("__to") - F.col("__from") + 1
    since = lambda c, missing: F.least(
        F.coalesce(F.unix_micros(c) - F.col("__from"), missing), beyond
    )
    marked = marked.withColumn(f"{p}_lo", since(f"{p}_begin", F.lit(0)))
    marked = marked.withColumn("__hi", F.greatest(since(f"{p}_end", beyond), F.col(f"{p}_lo")))
    lowest = _grid_level(F.expr("(__to - __from + 1) div __n"))
    marked = marked.withColumn("__level", F.greatest(_grid_level(F.col("__hi") - F.col(f"{p}_lo")), lowest))

    def place(kind: str, level: Column, cell: Column) -> Column:
        return F.struct(F.lit(kind).alias("__kind"), level.alias("__grid"), cell.alias("__cell"))

    at = lambda t, level: F.call_function("shiftright", t, level)
    lo, level = F.col(f"{p}_lo"), F.col("__level")
    cells = F.sequence(at(lo, level), at(F.col("__hi"), level))
    levels = F.sequence(lowest, F.greatest(_grid_level(beyond), lowest), F.lit(LEVEL_STEP))
    places = F.concat(
        F.transform(cells, lambda c: place(interval, level, c)),
        F.transform(levels, lambda v: place(begins, v, at(lo, v))),
    )
    return marked.select(*df.columns, f"{p}_lo", F.explode(places).alias("__at")).select(
        *df.columns, f"{p}_lo", "__at.*"
    )


def _pairs(src: DataFrame, dst: DataFrame, condition: Column) -> DataFrame:
    """Pairs of one match value that meet the interval condition, each once.

    Two intervals meet only if one begins inside the other: a source begin in a
    destination (kind ``s-in-d``), else a later destination begin in a source
    (``d-in-s``).  Begins and intervals meet on grid cells no shorter than the
    interval, so the work follows the overlaps and not the product of the group.
    """
    spans = _spans(src, dst)
    left = _placed(src, "s", spans, begins="s-in-d", interval="d-in-s")
    right = _placed(dst, "d", spans, begins="d-in-s", interval="s-in-d")
    met = (
        (F.col("s_match") == F.col("d_match"))
        & (left["__kind"] == right["__kind"])
        & (left["__grid"] == right["__grid"])
        & (left["__cell"] == right["__cell"])
    )
    right_kind = (left["__kind"] == "s-in-d") == (F.col("d_lo") <= F.col("s_lo"))
    return left.join(right, met & right_kind & condition).select(*src.columns, *dst.columns)


_FAR = "9999-12-31 23:59:59.999999"


def _gaps(found: DataFrame) -> DataFrame:
    """Stretches of matched source states that no destination covers, with a NULL destination."""
    far = F.lit(_FAR).cast("timestamp")
    until = F.coalesce("eind_geldigheid", far)
    by = [F.col("begin_geldigheid").asc_nulls_first()]
    # A source state may have any number of destinations: no window sees them all.
    narrow = found.select("__row", "begin_geldigheid", "eind_geldigheid")
    # What follows a row is told by a mark: the state's last row has none, and knows how far all of them reach.
    found = segments.with_neighbours(narrow, ["__row"], by, F.lit(1), until, "__following", "__reached")
    reached = F.col("__reached")
    start, stop = F.coalesce(reached, F.col("__row.s_begin")), F.col("begin_geldigheid")
    open_begin = reached.isNull() & F.col("__row.s_begin").isNull()
    gap = lambda b, e: F.struct(b.alias("begin_geldigheid"), e.alias("eind_geldigheid"))
    before = F.when(stop.isNotNull() & (open_begin | (start < stop)), gap(start, stop))
    last, end = F.greatest(reached, until), F.col("__row.s_end")
    after = F.when(F.col("__following").isNull() & (last < F.coalesce(end, far)), gap(last, end))
    return found.select("__row", F.explode(F.array_compact(F.array(before, after))).alias("__gap")).select("__row", "__gap.*")


def relate_temporal(
    src: DataFrame,
    dst: DataFrame,
    src_side: Side,
    dst_side: Side,
    ref_begin: str | None = None,
    fill_gaps: bool = False,
) -> DataFrame:
    """Relate source states to the destination states they overlap; NULL begin or end is unbounded.

    The relation holds over the intersection (half-open), begun no earlier than
    the reference itself.  A source state of zero length is matched at its
    moment: a state in force then (or of zero length then), else one that ends
    then, the highest number first.  Source states without a match give one row
    with a NULL destination; ``fill_gaps`` gives such rows for uncovered
    stretches of matched states too.  Copies of a source row each keep theirs.
    """
    s = src_side.standard(src, "s", F.col(ref_begin) if ref_begin else None)
    d = dst_side.standard(dst, "d").drop("d_own_begin")
    own, end = F.col("s_own_begin"), F.col("s_end")
    collapsed = F.coalesce(own == end, F.lit(False))
    s = s.withColumn("s_begin", F.when(collapsed, own).otherwise(F.col("s_begin")))
    states = s.select(F.struct(*s.columns).alias("__row")).groupBy("__row").agg(F.count(F.lit(1)).alias("__copies"))

    begin, until = F.greatest("s_begin", "d_begin"), F.least("s_end", "d_end")
    overlaps = F.coalesce(begin < until, F.lit(True))
    in_force = F.coalesce(F.col("d_begin") <= own, F.lit(True)) & F.coalesce(own < F.col("d_end"), F.lit(True))
    at_once = F.coalesce((F.col("d_begin") == own) & (F.col("d_end") == own), F.lit(False))
    ends_then = F.coalesce(F.col("d_end") == own, F.lit(False))
    # States and moments meet their destinations in one join; a state's are told apart, of a moment's the best is taken.
    pairs = _pairs(states.select("__row.*"), d, F.when(collapsed, in_force | at_once | ends_then).otherwise(overlaps))
    each = F.struct("d_id", "d_number", begin.alias("begin"), until.alias("until"))
    preference = F.when(in_force | at_once, F.lit(1)).otherwise(F.lit(0))
    met = pairs.select(
        F.struct(*s.columns).alias("__row"),
        F.when(~collapsed, each).alias("__one"),
        F.struct(preference.alias("p"), F.col("d_number").alias("n"), F.col("d_id").alias("id")).alias("__best"),
    )
    found = met.repartition("__row").groupBy("__row", "__one").agg(F.max("__best").alias("__best"), F.count(F.lit(1)).alias("__times"))
    point = F.col("__one").isNull()
    pick = lambda best, one: F.when(point, best).otherwise(one)
    found = found.select(
        "__row",
        pick(F.col("__best.id"), F.col("__one.d_id")).alias("d_id"),
        pick(F.col("__best.n"), F.col("__one.d_number")).alias("d_number"),
        pick(F.col("__row.s_own_begin"), F.col("__one.begin")).alias("begin_geldigheid"),
        pick(F.col("__row.s_end"), F.col("__one.until")).alias("eind_geldigheid"),
        pick(F.lit(1), F.col("__times")).alias("__times"),
        point.alias("__point"),
    )
    if fill_gaps:
        found = staged(found, "matches")
        found = found.unionByName(_gaps(found.where("NOT __point")), allowMissingColumns=True)
    joined = states.join(found, "__row", "left")
    # Copies of a source row each keep theirs, and so do copies of a destination.
    times = F.col("__copies") * F.coalesce("__times", F.lit(1))
    copied = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return copied.select("__row.s_id", "__row.s_number", "__row.s_match", "d_id", "d_number", "begin_geldigheid", "eind_geldigheid")
