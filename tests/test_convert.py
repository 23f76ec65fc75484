import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stateweave.functions import convert, wkt


@pytest.mark.parametrize(
    "type_, fmt, good, value, bad",
    [
        ("integer", None, "17", 17, "17x"),
        ("integer", None, "-3", -3, "2500000000"),
        ("biginteger", None, "2600000000", 2600000000, "1.5"),
        ("decimal", None, "3.25", Decimal("3.2500"), "3,25"),
        ("character", None, "q", "q", "qq"),
        ("boolean", "JN", "J", True, "Ja"),
        ("boolean", "JN", "N", False, "n"),
        ("boolean", "10", "0", False, "2"),
        ("date", "%m-%d-%Y", "02-28-2003", dt.date(2003, 2, 28), "28-02-2003"),
        ("date", "%Y-%m-%d", "2003-02-28", dt.date(2003, 2, 28), "2003-02-28 later"),
        ("datetime", None, "2020-05-06T07:08:09.000012", dt.datetime(2020, 5, 6, 7, 8, 9, 12), "0000-00-00T00:00:00"),
        ("datetime", "%Y-%m-%d %H:%M:%S", "2020-05-06 07:08:09", dt.datetime(2020, 5, 6, 7, 8, 9), "2020-05-06"),
        ("json", None, '{"a": [1, null]}', '{"a": [1, null]}', "{1:2}"),
        ("json", None, "null", "null", "{"),
        ("point", None, "POINT (1.5 -2)", "POINT (1.5 -2)", "POINT (1.5 -2)x"),
        ("point", None, "point( 1 2 )", "point( 1 2 )", "POINT (1 )"),
        ("polygon", None, "POLYGON (( 0 0, 2 0 , 2 2, 0.0 0))", "POLYGON (( 0 0, 2 0 , 2 2, 0.0 0))", "POLYGON ((0.0, 0.0))"),
        (
            "polygon",
            None,
            "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))",
            "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))",
            "POLYGON ((0 0, 9 0, 9 9, 0 1))",
        ),
        (
            "geometry",
            None,
            "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0)), ((1 1, 2 1, 2 2, 1 1)))",
            "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0)), ((1 1, 2 1, 2 2, 1 1)))",
            "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0),))",
        ),
        ("geometry", None, "LINESTRING (0 0, 1 1)", "LINESTRING (0 0, 1 1)", "LINESTRING (0 0)"),
    ],
)
def test_conversion(one, type_, fmt, good, value, bad):
    c = F.col("c")
    assert one(convert.convert(c, type_, fmt), c=good) == value
    assert one(convert.convert(c, type_, fmt), c=bad) is None
    assert one(convert.is_bad(c, type_, fmt), c=good) is False
    assert one(convert.is_bad(c, type_, fmt), c=bad) is True
    # Nothing given is not a bad value.
    assert one(convert.is_bad(c, type_, fmt), c="") is False
    assert one(convert.is_bad(c, type_, fmt), c=None) is False


@pytest.mark.parametrize(
    "text, parts",
    [
        ("2022-07-09", (2022, 7, 9)),
        ("2022-07-00", (2022, 7, None)),
        ("2022-00-00", (2022, None, None)),
        ("2022-00-09", None),
        ("2022-13-00", None),
        ("2022-02-30", None),
        ("2022-7-9", None),
    ],
)
def test_incomplete_date(one, text, parts):
    got = one(convert.convert(F.col("c"), "incomplete_date"), c=text)
    assert (got and (got.year, got.month, got.day)) == parts


def test_geometry_numbers(one):
    rings = wkt.rings(F.col("g"))
    square = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    assert one(wkt.polygon_area(rings), g=square) == 15.0
    assert one(wkt.polygon_wkt(rings), g=square) == square
    assert tuple(one(wkt.bounds(rings), g=square)) == (0.0, 0.0, 4.0, 4.0)
    assert tuple(one(wkt.vertex_average(rings), g="POINT (3 5)")) == (3.0, 5.0)
    assert tuple(one(wkt.vertex_average(rings), g=square)) == (2.0, 2.0)
    for x, y, inside in [(0.5, 0.5, True), (1.5, 1.5, False), (5.0, 1.0, False), (3.9, 3.9, True)]:
        assert one(wkt.contains(rings, F.lit(x), F.lit(y)), g=square) is inside


def test_simplify_drops_near_vertices_only(one):
    rings = lambda: wkt.polygon_wkt(wkt.simplify(wkt.rings(F.col("g")), 0.05))
    assert one(rings(), g="POLYGON ((0 0, 5 0.01, 10 0, 10 8, 0 8, 0 0))") == "POLYGON ((0 0, 10 0, 10 8, 0 8, 0 0))"
    kept = "POLYGON ((0 0, 5 0.06, 10 0, 10 8, 0 8, 0 0))"
    assert one(rings(), g=kept) == kept
    text = lambda: wkt.simplify_text(F.col("g"), 0.05)
    assert one(text(), g="polygon((0 0, 5 0.01, 10 0, 10 8, 0 8, 0 0))") == "POLYGON ((0 0, 10 0, 10 8, 0 8, 0 0))"
    many = "MULTIPOLYGON (((0 0, 5 0.01, 10 0, 10 8, 0 8, 0 0)), ((1 1, 2 1, 2 2, 1 1)))"
    assert one(text(), g=many) == "MULTIPOLYGON (((0 0, 10 0, 10 8, 0 8, 0 0)), ((1 1, 2 1, 2 2, 1 1)))"
    assert one(text(), g="POINT (1 2)") == "POINT (1 2)"
    # A ring that would fall apart stays.
    sliver = "POLYGON ((0 0, 5 0.01, 10 0, 0 0))"
    assert one(rings(), g=sliver) == sliver


def test_number_text(one):
    text = wkt.number_text(F.col("n").cast("double"))
    for value, shown in [("100", "100"), ("0.50", "0.5"), ("-0.0", "0"), ("1e7", "10000000"), ("4.123456789", "4.123456789"), ("1e-7", "0.0000001"), ("-12.5", "-12.5")]:
        assert one(text, n=value) == shown


def test_a_huge_ring_parses(one):
    points = ", ".join(f"{i} {i % 7}" for i in range(20000))
    g = f"POLYGON (({points}, 0 0))"
    assert one(F.size(wkt.rings(F.col("g"))[0]), g=g) == 20001
    assert one(convert.convert(F.col("g"), "polygon").isNotNull(), g=g) is True
