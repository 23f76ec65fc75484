import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from stateweave.operators import relations, spatial
from stateweave.operators.relations import Side

Y = lambda y: y and dt.datetime(y, 1, 1)
STATES = Side("id", "ref", "nr", "b", "e")
TARGET = Side("id", "id", "nr", "b", "e")
S = "id string, nr bigint, b timestamp, e timestamp, ref string"
D = "id string, nr bigint, b timestamp, e timestamp"


def related(src, dst, src_side=STATES, dst_side=TARGET, **options):
    rows = relations.relate_temporal(src, dst, src_side, dst_side, **options).collect()
    year = lambda t: t and t.year
    return sorted(
        ((r.s_id, r.s_number, r.d_id, r.d_number, year(r.begin_geldigheid), year(r.eind_geldigheid)) for r in rows), key=repr
    )


def test_intersections_gaps_and_open_ends(frame):
    dst = frame(D, *[("P", n, Y(b), Y(e)) for n, b, e in [(1, 1990, 1995), (2, 1995, 2000), (3, 2002, 2004), (4, 2006, None)]])
    src = frame(
        S,
        ("X", 1, Y(1991), Y(1994), "P"), ("X", 2, Y(1994), Y(2003), "P"), ("X", 3, Y(2004), Y(2006), "P"),
        ("X", 4, Y(2006), None, "P"), ("Z", 1, Y(1991), None, "weg"), ("Z", 2, Y(1991), None, None),
    )
    expected = sorted(
        [
            ("X", 1, "P", 1, 1991, 1994),
            ("X", 2, "P", 1, 1994, 1995), ("X", 2, "P", 2, 1995, 2000), ("X", 2, "P", 3, 2002, 2003),
            ("X", 3, None, None, None, None),
            ("X", 4, "P", 4, 2006, None),
            ("Z", 1, None, None, None, None), ("Z", 2, None, None, None, None),
        ],
        key=repr,
    )
    assert related(src, dst) == expected


def test_own_start_of_a_reference(frame):
    dst = frame(D, ("P", 1, Y(2000), Y(2010)), ("P", 2, Y(2010), None))
    src = frame(S + ", rb timestamp", ("X", 1, Y(2001), None, "P", Y(2012)), ("X", 2, Y(2001), None, "P", None))
    assert related(src, dst, ref_begin="rb") == [
        ("X", 1, "P", 2, 2012, None), ("X", 2, "P", 1, 2001, 2010), ("X", 2, "P", 2, 2010, None),
    ]


def test_a_source_row_without_a_match_stays_beside_one_with(frame):
    dst = frame(D, ("P", 1, Y(2000), Y(2001)))
    src = frame(S, ("X", 1, Y(2000), Y(2001), "P"), ("X", 1, Y(2005), Y(2006), "P"))
    expected = [("X", 1, "P", 1, 2000, 2001), ("X", 1, None, None, None, None)]
    assert related(src, dst) == expected


def test_stateless_ends(frame):
    src = frame(S, ("X", 1, Y(2001), Y(2002), "P"))
    plain = frame("id string", ("P",))
    assert related(src, plain, dst_side=Side("id", "id")) == [("X", 1, "P", None, 2001, 2002)]
    refs = frame("id string, ref string", ("X", "P"))
    states = frame(D, ("P", 1, Y(2000), None))
    assert related(refs, states, src_side=Side("id", "ref")) == [("X", None, "P", 1, 2000, None)]
    assert related(refs, plain, src_side=Side("id", "ref"), dst_side=Side("id", "id")) == [("X", None, "P", None, None, None)]


@pytest.mark.parametrize(
    "states, number",
    [
        ([(1, 2000, 2000), (2, 2000, 2000)], 2),
        ([(1, 1997, 1998), (2, 1998, 2000), (3, 2002, 2004)], 2),
        ([(1, 1997, 1998), (2, 2000, 2001), (3, 2001, None)], 2),
        ([(1, 1997, 1998), (2, 2000, None), (3, 2001, None)], 2),
        ([(1, 1997, 1998), (2, 1998, 2001), (3, 2001, None)], 2),
        ([(1, 1997, None), (2, 1999, None)], 2),
        ([(1, 2001, None)], None),
        # A state in force wins over a later number that only ends then.
        ([(3, 1990, 2000), (2, 1995, 2005)], 2),
    ],
)
def test_zero_length_source(frame, states, number):
    src = frame(S, ("X", 1, Y(2000), Y(2000), "P"))
    dst = frame(D, *[("P", n, Y(b), Y(e)) for n, b, e in states])
    (row,) = related(src, dst)
    assert row[3] == number


def test_copies_of_a_source_row_are_kept(frame):
    dst = frame(D, ("P", 1, Y(1999), None))
    for end, reference in ((2000, "P"), (2002, "P"), (2000, "weg"), (2002, "weg")):
        assert len(related(frame(S, *[("X", 1, Y(2000), Y(end), reference)] * 2), dst)) == 2


def test_gaps_of_matched_states_on_demand(frame):
    dst = frame(D, ("P", 1, Y(1990), Y(1995)), ("P", 2, Y(1993), Y(1996)), ("P", 3, Y(2002), Y(2004)))
    src = frame(S, ("X", 1, Y(1985), Y(2010), "P"), ("X", 2, None, None, "P"), ("X", 3, Y(1991), Y(1994), "P"), ("X", 4, Y(1997), Y(1999), "P"))
    found = related(src, dst, fill_gaps=True)
    gaps = [(r[1], r[4], r[5]) for r in found if r[2] is None]
    assert sorted(gaps, key=repr) == sorted(
        [(1, 1985, 1990), (1, 1996, 2002), (1, 2004, 2010), (2, None, 1990), (2, 1996, 2002), (2, 2004, None), (4, None, None)], key=repr
    )
    assert [r for r in found if r[2]] == [r for r in related(src, dst) if r[2]]


interval = st.tuples(st.one_of(st.none(), st.integers(1, 20)), st.one_of(st.none(), st.integers(1, 12))).map(
    lambda p: (p[0], p[1] and (p[0] or 0) + p[1])
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, min_size=1, max_size=6), st.lists(interval, min_size=1, max_size=6))
def test_relation_is_the_intersection(frame, sources, targets):
    src = frame(S, *[("X", i, b and Y(1900 + b), e and Y(1900 + e), "P") for i, (b, e) in enumerate(sources)])
    dst = frame(D, *[("P", i, b and Y(1900 + b), e and Y(1900 + e)) for i, (b, e) in enumerate(targets)])
    expected = set()
    for i, (b, e) in enumerate(sources):
        for j, (c, f) in enumerate(targets):
            lo, hi = max(b or -999, c or -999), min(e or 999, f or 999)
            if lo < hi:
                expected.add((i, j, None if lo == -999 else 1900 + lo, None if hi == 999 else 1900 + hi))
    got = related(src, dst)
    found = [(r[1], r[3], r[4], r[5]) for r in got if r[2]]
    assert set(found) == expected and len(found) == len(expected)
    assert {r[1] for r in got} == set(range(len(sources)))


def test_resolving_one_or_several(frame):
    refs = frame("src string, bronwaarde string", ("a", "v"), ("b", "w"), ("c", None), ("d", "null"))
    dst = frame("id string, attr string", ("2", "v"), ("1", "v"), ("3", "u"), ("4", None))
    one = {r["src"]: r["dst_id"] for r in relations.resolve_references(refs, dst, "id", "attr").collect()}
    assert one == {"a": "1", "b": None, "c": None, "d": None}
    many = relations.resolve_references(refs, dst, "id", "attr", multiple=True)
    assert sorted(r["dst_id"] for r in many.where("src = 'a'").collect()) == ["1", "2"]
    assert sorted(r["src"] for r in relations.dangling(refs, dst, "attr").collect()) == ["b", "d"]


def test_inverse(frame):
    owner, members = frame("k int", (1,), (2,)), frame("k int, m int", (1, 10), (1, 11), (3, 12))
    out = relations.relate_inverse(owner, members, "k", "k2", ["m"]) if False else relations.relate_inverse(
        owner, members.withColumnRenamed("k", "k2"), "k", "k2", ["m"]
    )
    assert sorted((r["k"], r["m"] or 0) for r in out.collect()) == [(1, 10), (1, 11), (2, 0)]


def test_explode_keeps_sources_without_references(frame):
    df = frame("id int, r array<struct<bronwaarde:string>>", (1, [("a",), ("b",)]), (2, []), (3, None))
    got = sorted((r["id"], r["bronwaarde"] or "") for r in relations.explode_references(df, "r", ["id"]).collect())
    assert got == [(1, "a"), (1, "b"), (2, ""), (3, "")]


def test_spatial_against_brute_force(frame):
    rng = random.Random(3)
    areas = []
    for k in range(40):
        x, y, w = rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.randint(-3, 6)
        areas.append((k, x, y, w))
    areas.append((99, *areas[7][1:]))
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(150)]
    wkt = "POLYGON (({0!r} {1!r}, {2!r} {1!r}, {0!r} {3!r}, {0!r} {1!r}))"
    area_rows = [(k, wkt.format(x, y, x + w, y + w)) for k, x, y, w in areas] + [(1000, None)]
    point_rows = [(i, f"POINT ({x!r} {y!r})") for i, x, y in points] + [(1000, None), (1001, "POINT EMPTY")]
    expected = {
        i: min((k for k, x, y, w in areas if px > x and py > y and (px - x) + (py - y) < w), default=None) for i, px, py in points
    } | {1000: None, 1001: None}
    out = spatial.relate_spatial(frame("p int, g string", *point_rows), frame("a int, g string", *area_rows), "p", "g", "a", "g")
    assert {r["p"]: r["a"] for r in out.collect()} == expected


def test_union_drops_copies(frame):
    box = lambda x: f"POLYGON (({x} 0, {x + 1} 0, {x + 1} 1, {x} 0))"
    members = frame("a string, g string", ("p", box(3)), ("p", box(1)), ("p", box(1)), ("q", box(5)), ("q", None))
    got = {r["a"]: (r["geometrie"], r["parts"]) for r in spatial.geometry_union(members, "a", "g").collect()}
    assert got == {
        "p": ("MULTIPOLYGON (((1 0, 2 0, 2 1, 1 0)), ((3 0, 4 0, 4 1, 3 0)))", 2),
        "q": ("MULTIPOLYGON (((5 0, 6 0, 6 1, 5 0)))", 1),
    }
    assert spatial.member_polygons(members, "a", "g").count() == 3


def test_union_and_area_of_multipolygons(frame):
    square = lambda x: f"({x} 0, {x + 1} 0,{x + 1} 1, {x} 1, {x} 0)"
    two = f"multipolygon (({square(0)}), ( {square(5)} ))"
    hole = "POLYGON ((0 0, 4.123456789 0, 4.123456789 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    members = frame("a string, g string", ("p", two), ("p", hole))
    (row,) = spatial.geometry_union(members, "a", "g").collect()
    assert row["parts"] == 3 and "4.123456789 0" in row["geometrie"] and "(1 1, 2 1, 2 2, 1 2, 1 1))" in row["geometrie"]
    (summary,) = spatial.area_summary(members, "a", "g").collect()
    assert abs(summary["area"] - (1 + 1 + 4 * 4.123456789 - 1)) < 1e-9 and summary["members"] == 2
