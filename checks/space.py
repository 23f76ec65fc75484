"""Spatial relations: orders as points, parts as triangles, order boxes united per customer."""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.operators import spatial


def _points(t):
    y = (F.col("o_orderkey") * 7) % 100
    return t.orders.select(
        "o_orderkey", F.format_string("POINT (%d.25 %d.5)", F.col("o_custkey"), y).alias("punt")
    )


def _triangles(t):
    x, y, w = F.col("p_partkey"), (F.col("p_partkey") * 37) % 100, F.col("p_size").cast("bigint")
    text = F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d))", x, y, x + w, y, x, y + w, x, y)
    return t.part.select("p_partkey", text.alias("vlak"))


@check(
    "j16_spatial_relation",
    """WITH p AS (SELECT o_orderkey, o_custkey + 0.25 AS x, (o_orderkey * 7) % 100 + 0.5 AS y FROM orders)
       SELECT o_orderkey, min(p_partkey) AS p_partkey FROM p LEFT JOIN part
         ON x > part.p_partkey AND y > (part.p_partkey * 37) % 100
        AND (x - part.p_partkey) + (y - (part.p_partkey * 37) % 100) < p_size
       GROUP BY o_orderkey""",
)
def _(t):
    return spatial.relate_spatial(_points(t), _triangles(t), "o_orderkey", "punt", "p_partkey", "vlak")


@check(
    "j16_spatial_relation_of_polygons",
    """WITH k AS (SELECT DISTINCT l_suppkey * 20 + 0.25 AS x, l_linenumber * 10 + 0.5 AS y,
                         l_suppkey * 100 + l_linenumber AS plek FROM lineitem)
       SELECT plek, min(p_partkey) AS p_partkey FROM k LEFT JOIN part
         ON x > part.p_partkey AND y > (part.p_partkey * 37) % 100
        AND (x - part.p_partkey) + (y - (part.p_partkey * 37) % 100) < p_size
       GROUP BY plek""",
)
def _(t):
    x, y = F.col("l_suppkey") * 20, F.col("l_linenumber") * 10
    box = F.format_string(
        "POLYGON ((%1$d %3$d, %2$d.5 %3$d, %2$d.5 %4$d, %1$d %4$d, %1$d %3$d))", x, x, y, y + 1
    )
    places = t.lineitem.select((F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("plek"), box.alias("vlak")).distinct()
    return spatial.relate_spatial(places, _triangles(t), "plek", "vlak", "p_partkey", "vlak")


def _boxes(t):
    x, y = F.col("o_orderkey") % 1000, F.round(F.col("o_totalprice") / 1000).cast("bigint") % 100
    text = F.format_string("POLYGON ((%1$d %2$d, %3$d %2$d, %3$d %4$d, %1$d %4$d, %1$d %2$d))", x, y, x + 2, y + 3)
    return t.orders.select("o_custkey", text.alias("vlak"))


@check(
    "a5_geometry_union",
    """WITH b AS (SELECT DISTINCT o_custkey, '((' || x || ' ' || y || ', ' || x + 2 || ' ' || y || ', ' || x + 2 || ' ' || y + 3 || ', '
                    || x || ' ' || y + 3 || ', ' || x || ' ' || y || '))' AS body
                   FROM (SELECT o_custkey, o_orderkey % 1000 AS x, CAST(round(o_totalprice / 1000) AS BIGINT) % 100 AS y FROM orders))
        SELECT o_custkey, 'MULTIPOLYGON (' || string_agg(body, ', ' ORDER BY body) || ')' AS geometrie, count(*) AS parts
        FROM b GROUP BY o_custkey""",
)
def _(t):
    return spatial.geometry_union(_boxes(t), "o_custkey", "vlak")


@check(
    "a5_area_summary",
    """SELECT o_custkey, CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x) + 2 AS DOUBLE) AS x1,
              CAST(max(y) + 3 AS DOUBLE) AS y1, CAST(6 * count(*) AS DOUBLE) AS area, count(*) AS members
       FROM (SELECT o_custkey, o_orderkey % 1000 AS x, CAST(round(o_totalprice / 1000) AS BIGINT) % 100 AS y FROM orders)
       GROUP BY o_custkey""",
)
def _(t):
    return spatial.area_summary(_boxes(t), "o_custkey", "vlak")
