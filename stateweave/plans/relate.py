"""Relations of an entity, drawn up from its definition.

A reference attribute says how its destination is found: by the value it
delivers, or, where ``bronwaarde`` is a marker (``=name``), by location or by a
key of its own that the destination carries.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.operators import relations, spatial
from stateweave.operators.mapping import REF, marker_of
from stateweave.operators.relations import Side
from stateweave.plans.definition import Definition

COLUMNS = ("src_id", "src_volgnummer", REF, "dst_id", "dst_volgnummer", "begin_geldigheid", "eind_geldigheid")


@dataclass(frozen=True)
class Destination:
    """The entity a reference leads to, and the columns it is found by; states have a number and a begin."""

    frame: DataFrame
    key: str = "_id"
    attribute: str | None = None
    number: str | None = None
    begin: str | None = None
    end: str | None = None
    geometry: str = "geometrie"
    multiple: bool = False

    @property
    def match(self) -> str:
        return self.attribute or self.key


def relate(
    definition: Definition,
    entity: DataFrame,
    destinations: Mapping[str, Destination],
    number: str = "volgnummer",
    begin: str = "begin_geldigheid",
    end: str = "eind_geldigheid",
    geometry: str = "geometrie",
    fill_gaps: bool = False,
) -> dict[str, DataFrame]:
    """Relation rows (``COLUMNS``) of each reference attribute that has a destination.

    ``=<geometry>`` relates by location, ``=<own attribute>`` to all destinations
    that carry its value.  Otherwise the delivered value is looked up: in time
    when either side has states, else by key or attribute.
    """
    has = lambda name: name if name in entity.columns else None
    out = {}
    for name, target in destinations.items():
        marker = marker_of(definition.mapping[name])
        if marker == geometry:
            rows = _by_location(entity, target, has(number), geometry)
        elif marker is not None:
            rows = _by_own_key(entity, target, has(number), marker)
        elif target.begin or has(begin):
            rows = _in_time(entity, target, name, has(number), has(begin), has(end), fill_gaps)
        else:
            rows = _by_value(entity, target, name, has(number))
        out[name] = rows.select(*COLUMNS)
    return out


def _text(c: str | None) -> Column:
    return (F.col(c) if c else F.lit(None)).cast("string")


def _number(c: str | None) -> Column:
    return (F.col(c) if c else F.lit(None)).cast("bigint")


def _timeless(rows: DataFrame) -> DataFrame:
    never = F.lit(None).cast("timestamp")
    return rows.withColumns({"begin_geldigheid": never, "eind_geldigheid": never})


def _by_location(entity: DataFrame, target: Destination, number: str | None, geometry: str) -> DataFrame:
    src = entity.select(F.struct(_text("_id").alias("id"), _number(number).alias("n")).alias("__src"), F.col(geometry).alias("__sg"))
    areas = target.frame.select(
        F.struct(_text(target.key).alias("id"), _number(target.number).alias("n")).alias("__dst"), F.col(target.geometry).alias("__dg")
    )
    found = spatial.relate_spatial(src, areas, "__src", "__sg", "__dst", "__dg")
    return _timeless(
        found.select(
            F.col("__src.id").alias("src_id"), F.col("__src.n").alias("src_volgnummer"), F.lit(None).cast("string").alias(REF),
            F.col("__dst.id").alias("dst_id"), F.col("__dst.n").alias("dst_volgnummer"),
        )
    )


def _by_own_key(entity: DataFrame, target: Destination, number: str | None, own: str) -> DataFrame:
    owner = entity.select(_text("_id").alias("src_id"), _number(number).alias("src_volgnummer"), _text(own).alias(REF))
    members = target.frame.select(
        _text(target.match).alias("__shared_value"), _text(target.key).alias("dst_id"), _number(target.number).alias("dst_volgnummer")
    )
    return _timeless(relations.relate_inverse(owner, members, REF, "__shared_value", ["dst_id", "dst_volgnummer"]))


def _references(entity: DataFrame, name: str, keep: list[Column]) -> DataFrame:
    """One row per reference, the entity's own columns under names that no reference has."""
    held = entity.select(*keep, F.col(name))
    return relations.explode_references(held, name, [c for c in held.columns if c != name])


def _in_time(
    entity: DataFrame, target: Destination, name: str, number: str | None, begin: str | None, end: str | None, fill_gaps: bool
) -> DataFrame:
    own = {"__number": number, "__begin": begin, "__end": end}
    refs = _references(entity, name, [_text("_id").alias("__id"), *[F.col(c).alias(k) for k, c in own.items() if c]])
    refs = refs.withColumn(REF, F.col(REF).cast("string"))
    since = "begin_geldigheid" if "begin_geldigheid" in refs.columns else None
    if since:
        refs = refs.withColumn(since, F.col(since).try_cast("timestamp"))
    dst = target.frame.withColumn("__match", _text(target.match)).withColumn("__key", _text(target.key))
    src_side = Side("__id", REF, *[k if c else None for k, c in own.items()])
    found = relations.relate_temporal(
        refs, dst, src_side, Side("__key", "__match", target.number, target.begin, target.end), ref_begin=since, fill_gaps=fill_gaps
    )
    return found.withColumnsRenamed({"s_id": "src_id", "s_number": "src_volgnummer", "s_match": REF, "d_id": "dst_id", "d_number": "dst_volgnummer"})


def _by_value(entity: DataFrame, target: Destination, name: str, number: str | None) -> DataFrame:
    refs = _references(entity, name, [_text("_id").alias("src_id"), _number(number).alias("src_volgnummer")])
    refs = refs.withColumn(REF, F.col(REF).cast("string")).select("src_id", "src_volgnummer", REF)
    dst = target.frame.select(_text(target.match).alias("__match"), F.struct(_text(target.key).alias("id"), _number(target.number).alias("n")).alias("__dst"))
    found = relations.resolve_references(refs, dst, "__dst", "__match", target.multiple, out="__found")
    return _timeless(found.select("src_id", "src_volgnummer", REF, F.col("__found.id").alias("dst_id"), F.col("__found.n").alias("dst_volgnummer")))
