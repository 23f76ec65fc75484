"""Geometry as WKT text at the edge and rings of (x, y) structs inside.

A geometry becomes ``array<array<struct<x,y>>>``: one array per ring (or per
part).  Every function is a built-in expression over that array, so a geometry
never leaves the row and nothing here shuffles.  Where a parsed value is used
more than once it is bound by ``let``, or parsed again for every use.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stateweave.functions.evaluate import let

_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
_POINT = rf"^\s*{_NUMBER}\s+{_NUMBER}\s*$"


def _ring_texts(wkt: Column) -> Column:
    return F.regexp_extract_all(wkt, F.lit(r"\(([^()]*)\)"), 1)


def rings(wkt: Column) -> Column:
    """Coordinates of every ring; a coordinate that is no number becomes NULL."""

    # Single blanks first: splitting on one character needs no pattern per point.
    spaced = F.regexp_replace(wkt, r"\s+", " ")

    def point(text):
        xy = F.split(F.trim(text), " ")
        return F.struct(
            F.try_element_at(xy, F.lit(1)).try_cast("double").alias("x"),
            F.try_element_at(xy, F.lit(2)).try_cast("double").alias("y"),
        )

    return F.transform(_ring_texts(spaced), lambda r: F.transform(F.split(r, ","), point))


def polygon_texts(wkt: Column) -> Column:
    """Bodies '((x y, ...), (...))' of the polygons of a POLYGON or MULTIPOLYGON, spaced alike, numbers as they are written."""
    tight = F.regexp_replace(F.regexp_replace(wkt, r"\s+", " "), r" ?([(),]) ?", "$1")
    return F.regexp_extract_all(F.replace(tight, F.lit(","), F.lit(", ")), F.lit(r"\((?:\([^()]*\)(?:, )?)+\)"), 0)


def polygons(wkt: Column) -> Column:
    """Rings of each polygon: which ring is a hole of which polygon stays known."""
    return F.transform(polygon_texts(wkt), rings)


def _skeleton(wkt: Column) -> Column:
    """Text with each innermost bracket as '#', blanks gone and repeats collapsed."""
    s = F.regexp_replace(wkt, r"\([^()]*\)", "#")
    s = F.upper(F.regexp_replace(s, r"\s+", ""))
    s = F.regexp_replace(s, r"(?<=#),#", "")
    return F.regexp_replace(s, r"(?<=\(#\)),\(#\)", "")


def _all_points(texts: Column) -> Column:
    return F.forall(texts, lambda r: F.forall(F.split(r, ","), lambda p: p.rlike(_POINT)))


def _all_closed(wkt: Column) -> Column:
    return F.forall(
        rings(wkt),
        lambda r: (F.size(r) >= 4) & (F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1))),
    )


def _long_enough(wkt: Column) -> Column:
    return let(_ring_texts(wkt), lambda texts: _all_points(texts) & (F.size(F.split(F.element_at(texts, 1), ",")) >= 2))


def _all_rings(wkt: Column) -> Column:
    return _all_points(_ring_texts(wkt)) & _all_closed(wkt)


# The shape of each kind once its coordinates are replaced by '#'.
_LINE_SHAPE = "LINESTRING#"
_POLYGON_SHAPE, _MULTI_SHAPE = "POLYGON(#)", "MULTIPOLYGON((#))"


def is_point(wkt: Column) -> Column:
    return wkt.rlike(rf"(?i)^\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*$")


def is_polygon(wkt: Column) -> Column:
    """A polygon or multipolygon whose rings are closed."""
    return _skeleton(wkt).isin(_POLYGON_SHAPE, _MULTI_SHAPE) & _all_rings(wkt)


def is_linestring(wkt: Column) -> Column:
    return (_skeleton(wkt) == _LINE_SHAPE) & _long_enough(wkt)


def is_geometry(wkt: Column) -> Column:
    def fits(shape):
        return (
            F.when(shape.isin(_POLYGON_SHAPE, _MULTI_SHAPE), _all_rings(wkt))
            .when(shape == _LINE_SHAPE, _long_enough(wkt))
            .otherwise(F.lit(False))
        )

    return F.when(is_point(wkt), F.lit(True)).otherwise(let(_skeleton(wkt), fits))


def number_text(c: Column) -> Column:
    """Plain text of a coordinate, every decimal of the double kept: no exponent, no trailing zeros."""
    fixed = c.cast("double").cast("string").try_cast("decimal(38,17)").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def point_wkt(x: Column, y: Column) -> Column:
    text = F.concat(F.lit("POINT ("), number_text(x), F.lit(" "), number_text(y), F.lit(")"))
    return F.when(x.isNotNull() & y.isNotNull(), text)


def _ring_wkt(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.concat_ws(" ", number_text(p["x"]), number_text(p["y"])))
    return F.concat(F.lit("("), F.array_join(points, ", "), F.lit(")"))


def polygon_body(ring_array: Column) -> Column:
    """'((x y, ...), (...))' without the leading word."""
    return F.concat(F.lit("("), F.array_join(F.transform(ring_array, _ring_wkt), ", "), F.lit(")"))


def polygon_wkt(ring_array: Column) -> Column:
    return F.concat(F.lit("POLYGON "), polygon_body(ring_array))


def multipolygon_wkt(bodies: Column) -> Column:
    """A MULTIPOLYGON from an array of polygon bodies."""
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(bodies, ", "), F.lit(")"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed counter-clockwise ring of a box."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def _edges(ring: Column, value) -> Column:
    """value(a, b) for each pair of following points."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), value)


def _total(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda acc, v: acc + v)


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area of one ring."""
    cross = _edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(_total(cross, F.lit(0.0))) / 2


def polygon_area(ring_array: Column) -> Column:
    """Outer ring minus holes."""
    return let(
        F.transform(ring_array, ring_area), lambda areas: F.element_at(areas, 1) * 2 - _total(areas, F.lit(0.0))
    )


def surface(polygon_array: Column) -> Column:
    """Area of all polygons of a geometry."""
    return _total(F.transform(polygon_array, polygon_area), F.lit(0.0))


def bounds(ring_array: Column) -> Column:
    """Bounding box as struct(x0, y0, x1, y1)."""

    def box(points):
        axis = lambda name: F.transform(points, lambda p: p[name])
        return F.struct(
            F.array_min(axis("x")).alias("x0"),
            F.array_min(axis("y")).alias("y0"),
            F.array_max(axis("x")).alias("x1"),
            F.array_max(axis("y")).alias("y1"),
        )

    return let(F.flatten(ring_array), box)


def vertex_average(ring_array: Column) -> Column:
    """Mean of the first ring's or line's vertices, a closing one left out; the point itself for a point."""

    def mean(outer):
        closed = (F.size(outer) > 1) & (F.try_element_at(outer, F.lit(1)) == F.try_element_at(outer, F.lit(-1)))
        n = F.size(outer) - F.when(closed, F.lit(1)).otherwise(F.lit(0))
        axis = lambda name: _total(
            F.transform(F.slice(outer, F.lit(1), n), lambda p: p[name]), F.lit(0.0)
        )
        return F.struct((axis("x") / n).alias("x"), (axis("y") / n).alias("y"))

    return let(F.try_element_at(ring_array, F.lit(1)), mean)


def contains(ring_array: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings, so holes and parts need no special care."""

    def crosses(a, b):
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return F.when(spans & (x < at), F.lit(1)).otherwise(F.lit(0))

    per_ring = F.transform(ring_array, lambda r: _total(_edges(r, crosses), F.lit(0)))
    return _total(per_ring, F.lit(0)) % 2 == 1


def simplify_ring(ring: Column, tolerance: float) -> Column:
    """Drop vertices nearer than the tolerance to the chord of their two neighbours.

    One pass, first and last vertex always kept, and the ring is left as it is
    when fewer than four vertices would remain.
    """

    def keep(p, i):
        a, b = F.try_element_at(ring, i), F.try_element_at(ring, i + 2)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        chord = F.sqrt(dx * dx + dy * dy)
        away = F.abs(dx * (a["y"] - p["y"]) - (a["x"] - p["x"]) * dy)
        near_line = F.try_divide(away, chord) < tolerance
        on_spot = (chord == 0) & (F.sqrt(F.pow(p["x"] - a["x"], 2) + F.pow(p["y"] - a["y"], 2)) < tolerance)
        inner = (i > 0) & (i < F.size(ring) - 1)
        # A zero index is an error in element_at, so the ends are decided first.
        return F.when(~inner, F.lit(True)).otherwise(~(F.coalesce(near_line, F.lit(False)) | on_spot))

    return let(F.filter(ring, keep), lambda kept: F.when(F.size(kept) >= 4, kept).otherwise(ring))


def simplify(ring_array: Column, tolerance: float) -> Column:
    return F.transform(ring_array, lambda r: simplify_ring(r, tolerance))


def simplify_text(wkt: Column, tolerance: float) -> Column:
    """A POLYGON or MULTIPOLYGON with simplified rings; other geometries as they are."""
    many = wkt.rlike(r"(?i)^\s*MULTIPOLYGON")
    bodies = F.transform(polygons(wkt), lambda p: polygon_body(simplify(p, tolerance)))
    one = let(bodies, lambda b: F.concat(F.lit("POLYGON "), F.element_at(b, 1)))
    return F.when(many, multipolygon_wkt(bodies)).when(wkt.rlike(r"(?i)^\s*POLYGON"), one).otherwise(wkt)
