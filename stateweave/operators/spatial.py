"""Relations by location and the union of member geometries.

Points and areas meet on grid cells.  Each area is filed at the grid level whose
cell is at least as large as the area, so it touches at most four cells however
large it is; a point is filed once per level in use.  No pair outside a shared
cell is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.functions import wkt
from stateweave.functions.evaluate import once

_LOWEST, _HIGHEST = -30, 60


def _level(extent: Column) -> Column:
    raw = F.ceil(F.log2(F.greatest(extent, F.lit(2.0**_LOWEST))))
    return F.greatest(F.lit(_LOWEST), F.least(F.lit(_HIGHEST), raw)).cast("int")


def _cell_size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _boxed_areas(areas: DataFrame, key: str, geometry: str) -> DataFrame:
    # Copies of a geometry answer alike, so the lowest key stands for them.
    known = areas.where(F.col(geometry).isNotNull())
    a = known.groupBy(F.col(geometry).alias("__wkt")).agg(F.min(key).alias("__area"))
    a = once(a, "__rings", wkt.rings(F.col("__wkt"))).where(F.size("__rings") > 0)
    a = once(a, "__b", wkt.bounds(F.col("__rings")))
    extent = F.greatest(F.col("__b.x1") - F.col("__b.x0"), F.col("__b.y1") - F.col("__b.y0"))
    return a.select("__area", "__rings", "__b", _level(extent).alias("__level"))


def _filed_areas(a: DataFrame) -> DataFrame:
    size = _cell_size(F.col("__level"))
    b = lambda n: F.col(f"__b.{n}")
    reach = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    a = a.withColumn("__cx", F.explode(reach(b("x0"), b("x1"))))
    return a.withColumn("__cy", F.explode(reach(b("y0"), b("y1"))))


def relate_spatial(
    src: DataFrame, areas: DataFrame, src_key: str, src_geometry: str, area_key: str, area_geometry: str
) -> DataFrame:
    """Area each source lies in: (source key, area key), NULL outside all; lowest area key on a tie.

    A source polygon is represented by the average of its vertices.
    """
    boxed = _boxed_areas(areas, area_key, area_geometry)
    filed = _filed_areas(boxed)
    # At most one entry per grid level, some ninety in all.
    levels = boxed.agg(F.collect_set("__level").alias("l")).scalar()
    placed = once(src.select(src_key, src_geometry), "__p", wkt.vertex_average(wkt.rings(F.col(src_geometry))))
    placed = placed.select(src_key, F.col("__p.x").alias("__x"), F.col("__p.y").alias("__y"))
    # A place is looked up once, however many sources share it.
    places = placed.where(F.col("__x").isNotNull() & F.col("__y").isNotNull()).select("__x", "__y").distinct()
    located = places.withColumn("__level", F.explode(levels))
    size = _cell_size(F.col("__level"))
    located = located.withColumn("__cx", F.floor(F.col("__x") / size)).withColumn("__cy", F.floor(F.col("__y") / size))
    x, y = F.col("__x"), F.col("__y")
    in_box = x.between(F.col("__b.x0"), F.col("__b.x1")) & y.between(F.col("__b.y0"), F.col("__b.y1"))
    # Parsed areas outgrow any size guessed from their table: they meet the places in a shuffle and are never broadcast.
    hits = located.join(filed.hint("merge"), ["__level", "__cx", "__cy"]).where(in_box & wkt.contains(F.col("__rings"), x, y))
    # The minimum is pre-aggregated in the join's own stage.
    lowest = hits.groupBy("__x", "__y").agg(F.min("__area").alias(area_key))
    return placed.join(lowest, ["__x", "__y"], "left").select(src_key, area_key)


def member_polygons(members: DataFrame, area: str, geometry: str, out: str = "polygon") -> DataFrame:
    """Each distinct member polygon of each area, a row each: for areas whose members have no bound."""
    known = members.where(F.col(area).isNotNull() & F.col(geometry).isNotNull())
    return known.select(area, F.explode(wkt.polygon_texts(F.col(geometry))).alias(out)).distinct()


def geometry_union(members: DataFrame, area: str, geometry: str, out: str = "geometrie") -> DataFrame:
    """One MULTIPOLYGON per area of its member polygons, sorted by text and not dissolved.

    ``members`` holds one row per (area, member POLYGON or MULTIPOLYGON).
    Polygons keep their holes and their coordinates as written; copies are
    dropped before the shuffle.  ``parts`` counts the polygons.
    """
    bodies = member_polygons(members, area, geometry, "__body")
    whole = bodies.groupBy(area).agg(F.array_sort(F.collect_list("__body")).alias("__all"))
    return whole.select(area, wkt.multipolygon_wkt(F.col("__all")).alias(out), F.size("__all").cast("bigint").alias("parts"))


def area_summary(members: DataFrame, area: str, geometry: str) -> DataFrame:
    """Bounding box, summed area and number of member polygons, all as mergeable aggregates."""
    r = once(members.select(area, geometry), "__r", wkt.polygons(F.col(geometry)))
    b = once(r, "__b", wkt.bounds(F.flatten("__r"))).select(area, "__b", wkt.surface(F.col("__r")).alias("__a"))
    return b.groupBy(area).agg(
        F.min("__b.x0").alias("x0"),
        F.min("__b.y0").alias("y0"),
        F.max("__b.x1").alias("x1"),
        F.max("__b.y1").alias("y1"),
        F.sum("__a").alias("area"),
        F.count(F.lit(1)).alias("members"),
    )
