"""Typed conversion of text made from the tables, with bad values mixed in."""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.functions import convert, wkt
from stateweave.functions.evaluate import once


def _sometimes(key, n, bad, good):
    return F.when(F.col(key) % n == 0, F.lit(bad)).otherwise(good)


@check(
    "t1_dates_by_format",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS mdy,
              CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS dmy,
              CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS moment,
              CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL 25457 MICROSECOND END AS iso FROM orders""",
)
def _(t):
    raw = lambda pattern: _sometimes("o_orderkey", 9, "0000-00-00", F.date_format("o_orderdate", pattern))
    iso = _sometimes("o_orderkey", 9, "0000-00-00T00:00:00", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".025457")))
    return t.orders.select(
        "o_orderkey",
        convert.convert(raw("MM-dd-yyyy"), "date", "%m-%d-%Y").alias("mdy"),
        convert.convert(raw("dd-MM-yyyy"), "date", "%d-%m-%Y").alias("dmy"),
        convert.convert(raw("yyyy-MM-dd HH:mm:ss"), "datetime", "%Y-%m-%d %H:%M:%S").alias("moment"),
        convert.convert(iso, "datetime").alias("iso"),
    )


@check(
    "t2_boolean_yes_no",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS vlag FROM lineitem""",
)
def _(t):
    raw = F.when(F.col("l_returnflag") == "A", "J").otherwise(F.col("l_returnflag"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", convert.convert(raw, "boolean", "JN").alias("vlag"))


@check("t3_boolean_one_zero", "SELECT doc_id, quality = 1 AS goed, toxic = 1 AS giftig FROM labels")
def _(t):
    return t.labels.select(
        "doc_id",
        convert.convert(F.col("quality"), "boolean", "10").alias("goed"),
        convert.convert(F.col("toxic"), "boolean", "10").alias("giftig"),
    )


@check(
    "t4_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              CASE WHEN l_partkey % 6 <> 0 THEN l_linenumber END AS klein,
              CASE WHEN l_partkey % 6 <> 0 THEN l_orderkey + 2500000000 END AS groot,
              CASE WHEN l_partkey % 6 <> 0 THEN l_discount END AS fractie FROM lineitem""",
)
def _(t):
    bad = lambda c: _sometimes("l_partkey", 6, "1invalid", c.cast("string"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        convert.convert(bad(F.col("l_linenumber")), "integer").alias("klein"),
        convert.convert(bad(F.col("l_orderkey") + F.lit(2500000000)), "biginteger").alias("groot"),
        convert.convert(bad(F.col("l_discount")), "decimal").cast("double").alias("fractie"),
    )


@check(
    "t5_character",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 6 <> 0 THEN l_linestatus END AS teken FROM lineitem""",
)
def _(t):
    raw = _sometimes("l_partkey", 6, "invalid", F.col("l_linestatus"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", convert.convert(raw, "character").alias("teken"))


@check(
    "t6_incomplete_date",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 <> 3 THEN year(o_orderdate) END AS BIGINT) AS jaar,
              CAST(CASE WHEN o_orderkey % 4 < 2 THEN month(o_orderdate) END AS BIGINT) AS maand,
              CAST(CASE WHEN o_orderkey % 4 = 0 THEN day(o_orderdate) END AS BIGINT) AS dag FROM orders""",
)
def _(t):
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-'00'"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-'00-00'"))
        .otherwise(F.date_format("o_orderdate", "yyyy-'00'-dd"))
    )
    # Month unknown but day known is no incomplete date.
    dated = once(t.orders.select("o_orderkey", raw.alias("raw")), "d", convert.convert(F.col("raw"), "incomplete_date"))
    part = lambda f: F.col(f"d.{f}").cast("bigint")
    return dated.select("o_orderkey", part("year").alias("jaar"), part("month").alias("maand"), part("day").alias("dag"))


@check(
    "t7_json",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS json FROM events""",
)
def _(t):
    return t.events.select("event_id", convert.convert(_sometimes("event_id", 5, "{1:2}", F.col("props")), "json").alias("json"))


@check(
    "t8_wkt_to_coordinates",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, -CAST(p_size AS DOUBLE) / 2 AS y,
              p_partkey % 5 <> 0 AS geldig, CAST(5 AS BIGINT) AS hoekpunten,
              p_partkey % 7 <> 0 AS gesloten, CAST(p_size * p_size AS DOUBLE) AS oppervlakte FROM part""",
)
def _(t):
    tail = F.when(F.col("p_partkey") % 5 == 0, F.lit("invalid")).otherwise(F.lit(""))
    point = F.concat(F.format_string("POINT (%d  -%s)", "p_size", (F.col("p_size") / 2).cast("string")), tail)
    last = F.when(F.col("p_partkey") % 7 == 0, F.lit("0.5 0.5")).otherwise(F.lit("0.0 0.0"))
    square = F.format_string("POLYGON (( 0.0 0.0,  %d  0.0, %d %d, 0 %d, %s))", *["p_size"] * 4, last)
    closed = F.format_string("POLYGON ((0 0, %d 0, %d %d, 0 %d, 0 0))", *["p_size"] * 4)
    head = F.element_at(F.element_at(wkt.rings(point), 1), 1)
    return t.part.select(
        "p_partkey",
        head["x"].alias("x"),
        head["y"].alias("y"),
        wkt.is_point(point).alias("geldig"),
        F.size(F.element_at(wkt.rings(square), 1)).cast("bigint").alias("hoekpunten"),
        convert.convert(square, "polygon").isNotNull().alias("gesloten"),
        wkt.polygon_area(wkt.rings(closed)).alias("oppervlakte"),
    )
